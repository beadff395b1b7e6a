"""Labels that a relative path implies: source, marker, subtype and disease group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.clean import col, contains_any

#: Markers in their order, and what in a source's name tells of a control or a subtype, first match first.
MARKERS = ("PCK", "WT1", "CAL")
CONTROLS = ("a549", "nsclc", "lung cancer")
SUBTYPES = ((("biphas", "msto"), "biphasic"), (("epithel",), "epithelioid"), (("sarcom",), "sarcomatoid"))
CELL_LINES = (("msto", "MSTO-211H"), ("a549", "A549"))


def markers(label: str | Column, names=MARKERS) -> Column:
    """The markers that stand in the label as tokens, joined by +, else the label itself. A token has no letter before
    it and neither letter nor digit behind it."""
    text = F.upper(col(label))
    found = F.concat_ws("+", *[F.when(F.rlike(text, F.lit(rf"(?<![A-Z]){m}(?![A-Z0-9])")), F.lit(m)) for m in names])
    return F.when(found != "", found).otherwise(col(label))


def path_labels(path: str | Column) -> dict[str, Column]:
    parts = F.split(col(path), "/")
    source = F.when(F.size(parts) > 1, parts[0]).otherwise("unknown")
    label = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("unlabelled")
    control, subtype = contains_any(source, CONTROLS), F.lit("unknown")
    for words, name in reversed(SUBTYPES):
        subtype = F.when(contains_any(source, words), name).otherwise(subtype)
    line = source
    for word, name in reversed(CELL_LINES):
        line = F.when(contains_any(source, [word]), name).otherwise(line)
    disease = F.when(control, "nsclc_control").when(subtype != "unknown", "mesothelioma").otherwise("unknown")
    return {"source_folder": source, "cell_line": line, "marker_label": label, "marker_group": markers(label), "subtype": F.when(control, "other/control").otherwise(subtype), "disease_group": disease}
