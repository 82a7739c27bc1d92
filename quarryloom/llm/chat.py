"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A turn becomes three text segments: its opening marker, its escaped text, its
closing marker. Only the text of a trained role is under the loss. Inside texts
the escape character stands before itself and before every place where a
control string begins, so reading a formatted conversation back is exact.

Conversations stream through sorted partitions with a state of fixed size, so a
conversation of any length needs no more memory than one of its turns. Its digest
is of its turns in order, so one task reads a conversation: time, unlike memory, grows with the longest.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Markers by role; ``other`` opens the turn of any other role, whose name then follows up to ``name_end``."""

    open: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other: "
    name_end: str = " ### "
    close: str = " </turn>\n"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    #: The state machine: which role may follow which; a conversation should end after one of ``final``.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def control_strings(self) -> list[str]:
        return sorted({x.strip() for x in (*self.open.values(), self.other, self.name_end, self.close)}, key=len, reverse=True)

    def escaper(self):
        places = re.compile("(?=" + "|".join(map(re.escape, [self.escape, *self.control_strings()])) + ")")
        return lambda text: places.sub(lambda _: self.escape, text)

    def unescaper(self):
        pair = re.compile(re.escape(self.escape) + "(.)", re.DOTALL)
        return lambda text: pair.sub(r"\1", text)

    def reader(self):
        """formatted turn -> (role, text)."""
        unescape, roles = self.unescaper(), sorted(self.open.items(), key=lambda x: -len(x[1]))

        def read(turn: str) -> tuple[str, str]:
            if not turn.endswith(self.close):
                raise ValueError(f"a turn without its end: {turn[-40:]!r}")
            body = turn[: -len(self.close)]
            for role, mark in roles:
                if body.startswith(mark):
                    return role, unescape(body[len(mark) :])
            if not body.startswith(self.other):
                raise ValueError(f"a turn without its start: {turn[:40]!r}")
            name, _, text = body[len(self.other) :].partition(self.name_end)  # a control string can't stand in an escaped name
            return unescape(name), unescape(text)

        return read


SEGMENTS = "conv_id long, turn_no long, state string, in_order boolean, segments array<struct<text:string,loss:boolean>>"


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn_no, state, in_order, segments), a row per turn, partitions sorted by conversation and turn.

    ``conversations`` needs conv_id, turn, role, text. Null text or role is empty;
    a null conv_id is a conversation; a null turn comes first; equal turns stand by
    role, then text, all of them. A turn that the machine doesn't allow is
    formatted too, with in_order false, and the machine goes on from its role. Texts of any
    length are formatted whole. Empty input gives an empty result; other columns are not read.
    """
    template = template or Template()

    def run(batches):
        escape, now, state, n = template.escaper(), object(), START, 0
        for b in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    now, state, n = conv, START, 0
                allowed = role in template.follows.get(state, ())
                state = role if role in template.follows else state
                mark = template.open[role] if role in template.open else f"{template.other}{escape(role)}{template.name_end}"
                out.append({"conv_id": conv, "turn_no": n, "state": state, "in_order": allowed, "segments": [{"text": mark, "loss": False}, {"text": escape(text), "loss": role in template.trained}, {"text": template.close, "loss": False}]})
                n += 1
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("state", pa.string()), ("in_order", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))]))

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, SEGMENTS)


def read_back(formatted: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """A row per conversation, from the rows of :func:`format_turns`, whatever order they are read in: digests of the turns and of the text under the loss, read back from the formatted text, and whether the machine accepted it.

    ``in_order`` says that they come straight from there, each conversation's
    together and in turn, which saves a shuffle. A null conv_id is a conversation. Empty input gives an empty result; other columns are not read.
    """
    template = template or Template()

    def run(batches):
        read, unescape = template.reader(), template.unescaper()
        now, row, done = object(), None, []

        def end():
            if row:
                done.append({k: (v.hexdigest() if k.endswith("256") else v) for k, v in row.items() if k != "state"} | {"valid": row["valid"] and row["state"] in template.final})

        for b in batches:
            for conv, state, in_order, segments in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "state", "in_order", "segments")), strict=True):
                if conv != now:
                    end()
                    now, row = conv, {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "valid": True, "state": START}
                turn = "".join(s["text"] for s in segments)
                role, text = read(turn)
                row["n_turns"] += 1
                row["turns_sha256"].update(f"{role}\n{text}\n".encode())
                row["formatted_chars"] += len(turn)
                row["valid"] &= in_order
                row["state"] = state
                for s in segments:
                    if s["loss"]:
                        learned = unescape(s["text"])
                        row["loss_chars"] += len(learned)
                        row["loss_sha256"].update(learned.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done.clear()
        end()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    columns = ["conv_id", "turn_no", "state", "in_order", "segments"]
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return formatted.select(columns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _sql_template(t: Template) -> str:
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    mark = " ".join(f"WHEN {q(role)} THEN {len(m)}" for role, m in t.open.items())
    return f"CASE role {mark} ELSE {len(t.other) + len(t.name_end)} + length(role) END + {len(t.close)}"


#: DuckDB SQL for the rows of op8, with the default template: every control string begins with ``###`` or is ``</turn>``, so the
#: places that are escaped are these, overlapping ones too, and the escape character.
SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
walked AS (
  SELECT *, coalesce(lag(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER w, 'start') AS before,
         length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0)
         + length(text) + {_sql_template(Template())} AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
       AND last(role ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ('system', 'user', 'assistant')) = 'assistant' AS valid
FROM walked GROUP BY conv_id
"""
