"""Personal data by candidate gradient boosting [native].

High-recall patterns propose spans, which may overlap. A candidate's kind, format and
neighbourhood become small whole-number features. Validators give the labels:
checksums (Luhn, mod 97), ranges (octets, areas, lengths); near-misses that they
refute are the negatives. A feature from which a kind's own rule could be read off
is blank for that kind, so that what the trees learn is what else valid spans have
in common. All candidates of all documents are counted by feature vector, a table
whose size the features' ranges bound; boosted trees are fitted to that table, and
become one SQL expression that scores every candidate. A threshold per kind
is calibrated on a held-out fold of documents. Candidates of the further kinds above it that their
validator doesn't refute are added to the base spans, unless they overlap one.

Positions: a text split at a pattern's matches gives the lengths between them.
Patterns are written possessively and start where a run starts, or where the last
match ended, so that they find what the plain ones find without stepping back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, written

#: The base kinds in their order, and their patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators, kind and pattern.
MORE = {
    "email_spelled": r"(?i)\b[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]++)++",
    "phone_plain": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[^\s]{6,}+)",
}
KINDS = [*BASE, *MORE]
#: Cheap tests that a text with a match always passes.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "email_spelled": r"(?i)[(\[]at[)\]]", "phone_plain": r"[0-9][ .-][0-9]{4}", "national_id": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"(?i)akia|[a-z][ \t]*[=:]"}
CONTEXT = 24
_WORDS_NEAR = r"(?i)mail|contact|phone|call|tel|fax|card|visa|credit|iban|account|ssn|social|address|host|server|login|password|user"
#: Features of which a kind's validator is made.
OF_RULE = {"card": ("digits", "size"), "phone": ("digits", "size"), "secret": ("digits", "size", "variety"), "email_spelled": ("size",)}
#: Features and their number of values.
FEATURES = {"digits": 8, "marks": 4, "variety": 4, "size": 6, "near": 2, "glued": 2, "letters": 2}


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, start, end, found>> of a pattern's matches, by code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    add = lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))).alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    kind_type = "array<struct<kind:string,start:int,end:int,found:string>>"
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind_type).alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(_NEEDS[kind]), walked).otherwise(F.array().cast(kind_type))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(found: Column) -> Column:
    """Whether an account number's remainder by 97 is 1: its first four characters behind the rest, letters as 10 to 35."""
    plain = F.upper(F.regexp_replace(found, "[^0-9A-Za-z]", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 1 << 30), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(s: Column) -> Column:
    """What a kind's validator says; null where it can't judge."""
    digits = _digits(s["found"])
    n = F.length(digits)
    octets = F.size(F.filter(F.split(s["found"], r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))) == 0
    return (
        F.when(s["kind"] == "email", F.lit(True))
        .when(s["kind"] == "ip", octets)
        .when(s["kind"] == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(s["kind"] == "phone", n.between(8, 15))
        .when(s["kind"] == "national_id", ~s["found"].rlike("^(?:000|666|9)") & ~s["found"].rlike("-00-|-0000$"))
        .when(s["kind"] == "phone_plain", ~digits.rlike("^[01]"))
        .when(s["kind"] == "secret", s["found"].rlike("[0-9]") & (F.length(F.regexp_replace(s["found"], r"^.*[=:][ \t]*", "")) >= 8))
        .when(s["kind"] == "iban", F.when(n >= 10, _mod97(s["found"])).otherwise(False))
        .otherwise(s["found"].rlike("(?i)[a-z]{2,}$"))
    )


def _features(s: Column, text: Column) -> dict[str, Column]:
    before = F.substring(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    n = F.length(_digits(s["found"]))
    told = {
        "digits": F.least(F.floor(n / 3), F.lit(7)),
        "marks": F.least(F.length(F.regexp_replace(s["found"], "[A-Za-z0-9]", "")), F.lit(3)),
        "variety": F.least(F.floor(F.size(F.array_distinct(F.split(F.lower(s["found"]), ""))) / 5), F.lit(3)),
        "size": F.least(F.floor((s["end"] - s["start"]) / 5), F.lit(5)),
        "near": before.rlike(_WORDS_NEAR).cast("int"),
        "glued": (before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")).cast("int"),
        "letters": s["found"].rlike("[A-Za-z]").cast("int"),
    }
    blank = {f: [k for k, names in OF_RULE.items() if f in names] for f in told}
    return {f: F.when(s["kind"].isin(blank[f]), 0).otherwise(v) if blank[f] else v for f, v in told.items()}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, fold, spans): every proposed span of every whole text, with its validator's word and its features; matched text isn't kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", "text", F.concat(*[_spans(F.col("text"), k, p) for k, p in (BASE | MORE).items()]).alias("spans"))

    def told(s: Column) -> Column:
        features = [v.cast("int").alias(k) for k, v in _features(s, F.col("text")).items()]
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(_valid(s), F.lit(False)).alias("valid"), *features)

    return docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), fold(F.col("doc_id"), 5).alias("fold"), F.transform("spans", told).alias("spans"))


class Boosted:
    """Gradient boosted trees of depth 2 with logistic loss, over whole-number features with weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 20, rate: float = 0.4):
        self.trees: list[tuple] = []
        p = (weight @ y + 1) / (weight.sum() + 2)
        self.bias = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.bias)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = weight * (y - q), weight * q * (1 - q)
            tree, step = self._grow(x, g, h, np.arange(len(y)), 2)
            self.trees.append(self._scaled(tree, rate))
            score = score + rate * step

    def _grow(self, x, g, h, rows, depth):
        """(feature, cut, left, right) or a leaf's value, and the value of each row."""
        G, H = g[rows].sum(), h[rows].sum() + 1
        leaf = float(G / H)
        best = (1e-6, None)
        if depth and len(rows):
            for f in range(x.shape[1]):
                v = x[rows, f]
                gs, hs = np.bincount(v, g[rows], v.max() + 1).cumsum(), np.bincount(v, h[rows], v.max() + 1).cumsum()
                for cut in range(len(gs) - 1):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (G - gs[cut]) ** 2 / (H - hs[cut]) - G * G / H
                    if gain > best[0]:
                        best = (gain, (f, cut))
        out = np.zeros(len(x))
        if best[1] is None:
            out[rows] = leaf
            return leaf, out
        f, cut = best[1]
        low = x[rows, f] <= cut
        a, one = self._grow(x, g, h, rows[low], depth - 1)
        b, two = self._grow(x, g, h, rows[~low], depth - 1)
        return (f, cut, a, b), one + two

    def _scaled(self, tree, rate):
        return tree * rate if isinstance(tree, float) else (tree[0], tree[1], self._scaled(tree[2], rate), self._scaled(tree[3], rate))

    def expression(self, features: list[Column]) -> Column:
        def of(tree) -> Column:
            return F.lit(tree) if isinstance(tree, float) else F.when(features[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        def of(tree, rows):
            return np.full(len(rows), tree) if isinstance(tree, float) else np.where(rows[:, tree[0]] <= tree[1], of(tree[2], rows), of(tree[3], rows))

        return 1 / (1 + np.exp(-(self.bias + sum((of(t, x) for t in self.trees), np.zeros(len(x))))))


def counted(cands: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, feature vectors (kinds as a column each), labels, counts and whether held out, of all candidates.

    At most as many rows reach the driver as there are kinds, feature vectors, labels and folds.
    """
    rows = cands.select("fold", F.inline("spans")).groupBy("kind", *FEATURES, "valid", (F.col("fold") == 0).alias("held")).count().collect()
    rows.sort(key=lambda r: tuple(map(str, r)))
    kinds = np.array([KINDS.index(r["kind"]) for r in rows], int)
    x = np.array([[*(int(k == r["kind"]) for k in KINDS), *(r[f] for f in FEATURES)] for r in rows], int).reshape(len(rows), len(KINDS) + len(FEATURES))
    return kinds, x, *(np.array([float(r[c]) for r in rows]) for c in ("valid", "count", "held"))


def fit(cands: DataFrame, precision: float = 0.95) -> tuple[Boosted | None, dict[str, float]]:
    """Trees, and a threshold by kind: the lowest score above which at least ``precision`` of the held-out fold's candidates are valid; above 1 if none is."""
    kinds, x, y, w, held = counted(cands)
    if not len(x):
        return None, dict.fromkeys(KINDS, 2.0)
    learn = held == 0 if (held == 0).any() else held == held
    model = Boosted(x[learn], y[learn], w[learn])
    p, limits = model.scores(x), {}
    for k, kind in enumerate(KINDS):
        on = (kinds == k) & (held == 1)
        on = on if w[on].sum() >= 20 else kinds == k  # too few are held out to judge by
        limits[kind] = 2.0
        for cut in sorted(set(p[on].round(6)), reverse=True):  # the last that meets it is the lowest
            above = on & (p >= cut - 1e-6)
            if w[above] @ y[above] >= precision * w[above].sum():
                limits[kind] = float(cut - 1e-6)
    return model, limits


def evaluated(cands: DataFrame, precision: float = 0.95) -> dict[str, tuple[float, float, int]]:
    """Of each kind's held-out candidates: precision and recall of the trees at the kind's threshold (not helped by the validator), and how many there are."""
    kinds, x, y, w, held = counted(cands)
    model, limits = fit(cands, precision)
    out = {}
    for k, kind in enumerate(KINDS):
        on = (kinds == k) & (held == 1)
        if w[on].sum():
            above = on & (model.scores(x) >= limits[kind])
            out[kind] = (float(w[above] @ y[above] / max(1, w[above].sum())), float(w[above] @ y[above] / max(1, w[on] @ y[on])), int(w[on].sum()))
    return out


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, text_sha256), a row per row of ``docs`` (doc_id, text; other columns are not read).

    A base span is a valid match of a base pattern. ``spans`` has these and what the
    trees add: kind:start:end in code points, by kind as listed in ``KINDS``, then
    start. A null text is empty; texts of any length are read whole. Rows that share an id, or have none, are
    each judged by their own text; they are in the same fold. Without any candidate, as in an empty table, nothing is learned and nothing found.
    """
    cands = written(candidates(docs), "pii-candidates")
    model, limits = fit(cands)
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)) & s["valid"])
    cands = cands.select("doc_id", "text_sha256", "spans", base.alias("base"))

    def added(s: Column) -> Column:
        p = model.expression([*((s["kind"] == k).cast("int") for k in KINDS), *(s[f] for f in FEATURES)])
        enough = sum((F.when(s["kind"] == k, F.lit(limits[k])).otherwise(0.0) for k in KINDS), F.lit(0.0))
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(s["kind"].isin(list(BASE)), s["valid"]).otherwise(s["valid"] & (p >= enough) & apart)  # what a kind's validator refutes stays out

    if model:
        cands = cands.withColumn("spans", F.when(F.size("spans") > 0, F.filter("spans", added)).otherwise(F.col("spans")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return cands.select("doc_id", *[count(k) for k in BASE], F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), "text_sha256")


def redact(docs: DataFrame, found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with the spans that :func:`find_personal_data` found replaced by their kind. Overlapping spans are one, named by the first.

    A row gets what was found in its own text, also where rows share an id or have
    none. All columns are kept, whatever their names; a null text stays null.
    """
    told, key, sha = (fresh(docs, c) for c in ("_spans", "_id", "_sha"))
    spans = F.filter(F.split(F.col(told), ","), lambda s: s != "")
    parts = F.array_sort(F.transform(spans, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind"))))
    before, after = (F.lit(x) for x in mark.split("{}"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), before, s["kind"], after).alias("out")))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    side = found.filter("n_spans > 0").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), F.col("spans").alias(told)).dropDuplicates([key, sha])
    same = docs["doc_id"].cast("long").eqNullSafe(side[key]) & (F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256) == side[sha])
    return docs.join(side, same, "left").withColumn("text", F.when(F.size(parts) > 0, whole).otherwise(F.col("text"))).select(*docs.columns)
