"""Training-data operators: ten stages of a corpus pipeline, each usable alone."""
