"""Splitting oversized texts at natural boundaries, with overlap.

One regular expression with bounded quantifiers consumes the text from left to right: its alternatives are ordered by
the strength of the boundary they end at (paragraph, line, word), each takes as much as fits, and the last one takes
characters where no boundary is in reach. The rest is array functions on the matches: where a piece was cut, and how
much of the piece before it is repeated in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Not between the two characters of a CRLF.
_WHOLE = r"(?!(?<=\r)\n)"
#: Positions at or inside a run of the boundary's characters, strongest boundary first.
_BOUNDARIES = {
    "paragraph": rf"(?:{_WHOLE}(?:(?<=\n\r?\n)|(?<=\n)(?=\r?\n)|(?=\r?\n\r?\n))|\z)",
    "line": rf"(?:{_WHOLE}(?:(?<=\n)|(?=\r?\n))|\z)",
    "word": rf"(?:{_WHOLE}(?:(?<=[ \t\r\n])|(?=[ \t\r\n]))|\z)",
}
_MARK = "\u0001"
#: The same on the joint of two pieces: up to three characters before the mark, up to four after it.
_JOINTS = {
    "paragraph": rf"\n\r?\n{_MARK}|\n{_MARK}\r?\n|{_MARK}\r?\n\r?\n",
    "line": rf"\n{_MARK}|{_MARK}\r?\n",
    "word": rf"[ \t\r\n]{_MARK}|{_MARK}[ \t\r\n]",
}
STRENGTH = ("paragraph", "line", "word", "char")


def piece_pattern(limit: int, overlap: int) -> str:
    """The regular expression whose successive matches are the pieces.

    Of each boundary a piece that leaves room for the overlap is preferred to one that needs the whole limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    room = limit - overlap
    return "(?s)" + "|".join([f".{{1,{n}}}{at}" for at in _BOUNDARIES.values() for n in dict.fromkeys((room, limit))] + [f".{{1,{room}}}"])


def split_items(df: DataFrame, key: Column, text: Column, limit: int, overlap: int) -> DataFrame:
    """(key, n_chars, cut_at, pieces) for each row; pieces: array of (start, cut, overlap, text).

    Without their overlap the pieces joined give the text again. ``text`` of a piece begins with the last ``overlap``
    characters of the piece before it: as many as asked for, as that piece has, and as the limit leaves room for.
    ``start`` is the offset, in characters, of what follows the overlap. ``cut`` says what the piece ends at (``end``
    for the last one), ``cut_at`` is the weakest cut of the item. A text within the limit is one piece and has no
    ``cut_at``; an empty text has no pieces; a null text gives nulls. Repeated rows are kept as they are; other columns
    are pruned, whatever their names.
    """
    pattern = piece_pattern(limit, overlap)
    items = df.select(key.alias("key"), text.alias("text"))
    cores = items.select("key", F.length("text").alias("n_chars"), F.when(F.length("text") > limit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).when(F.length("text") == 0, F.array().cast("array<string>")).otherwise(F.when(F.col("text").isNotNull(), F.array("text"))).alias("cores"))

    joined = F.zip_with(F.col("cores"), F.slice("cores", F.lit(2), F.greatest(F.size("cores") - 1, F.lit(0))), _cut)
    cut = cores.withColumn("cuts", joined).withColumn("sizes", F.transform("cores", lambda c: F.length(c)))
    weakest = F.lit(None).cast("string")
    for name in STRENGTH:
        weakest = F.when(F.array_contains("cuts", name), name).otherwise(weakest)
    starts = F.aggregate("sizes", F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    before = F.concat(F.array(F.lit("")), F.col("cores"))
    lined = F.arrays_zip(F.col("cores").alias("core"), F.col("cuts").alias("cut"), starts.alias("start"), before.alias("before"))
    at = F.filter(lined, lambda z: z["core"].isNotNull())

    def piece(z: Column) -> Column:
        back = F.least(F.lit(overlap), F.lit(limit) - F.length(z["core"]), F.length(z["before"]))
        return F.struct(z["start"].alias("start"), z["cut"].alias("cut"), back.alias("overlap"), F.concat(F.right(z["before"], back), z["core"]).alias("text"))

    return cut.select("key", "n_chars", weakest.alias("cut_at"), F.transform(at, piece).alias("pieces"))


def _cut(core: Column, after: Column) -> Column:
    """What the joint of a piece and the one after it is cut at."""
    joint = F.concat(F.right(core, F.lit(3)), F.lit(_MARK), F.substring(after, 1, 4))
    kind = F.lit("char")
    for name in reversed(STRENGTH[:3]):
        kind = F.when(joint.rlike(_JOINTS[name]), name).otherwise(kind)
    return F.when(after.isNull(), "end").otherwise(kind)
