"""Document fingerprints: a Merkle tree over the paragraphs and sections of every text (operator 13, native).

A paragraph is a line; a section ends after a blank line or after a paragraph whose digest starts with 0 or 1,
so a section's end depends on its last paragraph alone and an edit moves no other section's ends.  Below the
paragraphs stand pieces: runs to the next sentence end, 24 to 64 code points long; the first 64 code points of the
first four paragraphs stand in pieces of 2 to 16, so that short texts have branches too.

* paragraph digest = sha256 of the paragraph, section digest = sha256 of the joined digests of
  its paragraphs, root = sha256 of the joined digests of the sections.
* fingerprint = root, then each section after ``/``, its paragraphs divided by ``.``, a paragraph as the marks of
  its pieces: 10 hexadecimal digits of the piece's digest and its length in three decimal digits.
* likeness of two fingerprints: 1 for equal roots, else the share of the code points that stand in pieces of equal
  marks: 2 * common / (one + other); a mark that stands several times in both is common as often as in the one with fewer.

Nulls: a null text is the empty text; its fingerprint is that of the empty text, its likeness to any other text 0.
Everything is an expression on one row, so repeated rows, ties, empty tables and further columns need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceframe.operators.ordering import dense_index

#: Pieces of a paragraph: to a sentence's end, or as long as may be.
PIECE = r"(?s).{24,63}?[.!?;] |.{1,64}"
#: (start, length) of the pieces at the beginning of a text's first paragraphs.
HEAD = ((1, 2), (3, 2), (5, 2), (7, 2), (9, 4), (13, 4), (17, 8), (25, 8), (33, 16), (49, 16))
HEAD_CHARS = 64
HEAD_PARAGRAPHS = 4
_SECTION_END = ("0", "1")


def _concat(parts: Column) -> Column:
    return F.array_join(parts, "")


def _paragraph(paragraph: Column, number: Column) -> Column:
    """Struct (digest, marks, blank) of a line, the ``number``-th of its text, from 0."""
    head = F.filter(F.array(*[F.substring(paragraph, s, n) for s, n in HEAD]), lambda p: p != "")
    pieces = F.when(number < HEAD_PARAGRAPHS, F.concat(head, F.regexp_extract_all(F.substring(paragraph, HEAD_CHARS + 1, 2**31 - 1), F.lit(PIECE), 0))) \
        .otherwise(F.regexp_extract_all(paragraph, F.lit(PIECE), 0))
    mark = F.transform(pieces, lambda p: F.concat(F.left(F.md5(p.cast("binary")), F.lit(10)), F.lpad(F.length(p).cast("string"), 3, "0")))
    return F.struct(F.sha2(paragraph.cast("binary"), 256).alias("digest"), mark.alias("marks"), (paragraph == "").alias("blank"))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: array of struct (digest, marks, blank)."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _paragraph)


def _ends_section(p: Column) -> Column:
    return p["blank"] | F.left(p["digest"], F.lit(1)).isin(*_SECTION_END)


def sections(paragraphs: Column) -> Column:
    """Section digests, from the paragraphs' digests."""
    joined = F.array_join(F.transform(paragraphs, lambda p: F.concat(p["digest"], F.when(_ends_section(p), "/").otherwise(""))), "")
    return F.transform(F.filter(F.split(joined, "/", -1), lambda s: s != ""), lambda s: F.sha2(s, 256))


def root(paragraphs: Column) -> Column:
    return F.sha2(_concat(sections(paragraphs)), 256)


def fingerprint_text(root: Column, paragraphs: Column) -> Column:
    """Root and marks as one string."""
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(_concat(p["marks"]), F.when(_ends_section(p), "/").otherwise("."))), "")
    return F.concat(root, F.lit("/"), F.regexp_replace(body, "[./]$", ""))


def marks(paragraphs: Column) -> Column:
    """All marks of a text; the second and later ones of equal marks have their number behind them."""
    def numbered(m: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(m) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))  # of the runs of equal marks

        def run(first: Column, k: Column, starts: Column) -> Column:
            length = F.coalesce(F.get(starts, k + 1), F.size(m)) - first
            return F.transform(F.sequence(F.lit(1), length), lambda t: F.when(t == 1, F.get(m, first)).otherwise(F.concat(F.get(m, first), F.lit("#"), t.cast("string"))))

        return F.transform(F.array(starts), lambda s: F.flatten(F.transform(s, lambda first, k: run(first, k, s))))[0]

    def of(m: Column) -> Column:
        return F.when(F.size(F.array_distinct(m)) == F.size(m), m).otherwise(F.transform(F.array(F.array_sort(m)), numbered)[0])

    return F.transform(F.array(F.flatten(F.transform(paragraphs, lambda p: p["marks"]))), of)[0]


def _weight(m: Column) -> Column:
    return F.aggregate(m, F.lit(0).cast("bigint"), lambda s, x: s + F.substring(x, 11, 3).cast("bigint"))


def likeness(root_a: Column, marks_a: Column, root_b: Column, marks_b: Column) -> Column:
    """Share of code points in equal pieces, 0 to 1; 1 for equal roots."""
    total = _weight(marks_a) + _weight(marks_b)
    return (F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0))
            .otherwise(F.lit(2.0) * _weight(F.array_intersect(marks_a, marks_b)) / total))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>paragraphs``, ``<prefix>root`` and ``<prefix>marks`` of a text column."""
    par = f"{prefix}paragraphs"
    df = df.withColumn(par, paragraphs(F.col(text)))
    return df.withColumns({f"{prefix}root": root(F.col(par)), f"{prefix}marks": marks(F.col(par))})


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text; equal texts have equal fingerprints."""
    src = docs.withColumn("merkle__p", paragraphs(F.col(text)))
    return src.withColumn(out, fingerprint_text(root(F.col("merkle__p")), F.col("merkle__p"))).drop("merkle__p")


def edits(before: Column, after: Column) -> Column:
    """Where two texts differ, by their trees' branches: array of struct (paragraph, side) in order.

    Sections of equal digests are passed over whole; in the others the paragraphs that the other side lacks are
    listed with their number (from 0) and ``before`` or ``after``.  Equal texts give an empty array."""
    def numbered(par: Column) -> Column:
        # the section a paragraph stands in = how many sections ended before it
        return F.transform(par, lambda p, i: F.struct(
            i.alias("paragraph"), p["digest"].alias("digest"),
            F.size(F.filter(F.slice(par, F.lit(1), i), _ends_section)).alias("section")))

    def lacking(mine: Column, other: Column, side: str) -> Column:
        own, theirs = sections(mine), sections(other)
        digests = F.transform(other, lambda p: p["digest"])
        open_ = F.filter(numbered(mine), lambda p: ~F.coalesce(F.array_contains(theirs, F.get(own, p["section"])), F.lit(False))
                         & ~F.array_contains(digests, p["digest"]))
        return F.transform(open_, lambda p: F.struct(p["paragraph"].alias("paragraph"), F.lit(side).alias("side")))

    a, b = paragraphs(before), paragraphs(after)
    same = root(a) == root(b)
    found = F.concat(lacking(a, b, "before"), lacking(b, a, "after"))
    return F.when(same, F.filter(found, lambda _: F.lit(False))).otherwise(found)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and likenesses: the query of operator 13.

    The edited text has the last floor(n/3) code points replaced by the first as many of the next document by
    descending doc_id (after the last the first).  Rows of one id follow each other by the digest of their texts,
    rows without an id come last; equal rows are each other's next, so the last copy alone meets the next
    document.  A row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Only doc_id and text are read; an empty table gives no rows.

    The order is made of ids and digests alone.  Texts are shuffled once, by (id, digest), and that shuffle is
    read twice: by the documents and by the beginnings they give to the one before them."""
    src = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # "n" as text stands for a missing id, so that joins need no null-safe keys
    src = src.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")).alias("id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("dig"),
                     "text", F.length("text").cast("bigint").alias("n"))
    keys = src.select("id", "dig", "doc_id", "n").distinct()
    order = dense_index(keys, [F.col("doc_id").desc_nulls_last(), F.col("id"), F.col("dig")])
    order = order.select("id", "dig", "pos", F.floor(F.col("n") / 3).cast("bigint").alias("cut"))
    total = max(order.count(), 1)
    # who asks: the key before; how many code points it wants
    asks = order.select(F.pmod(F.col("pos") + 1, F.lit(total)).alias("pos"), F.col("id").alias("to_id"), F.col("dig").alias("to_dig"), "cut")
    asks = order.drop("cut").join(asks, "pos").drop("pos")

    # one row per (id, text); every reader below takes the whole struct and the count, so that Spark sees one and
    # the same shuffle in all three and makes it once
    copies = src.groupBy("id", "dig").agg(F.first(F.struct("doc_id", "text", "n")).alias("d"), F.count(F.lit(1)).alias("copies"))
    one = F.least("copies", F.lit(1))
    begin = F.col("d.text").substr(F.lit(1), F.col("cut").cast("int"))

    def as_next(rows: DataFrame, id_: str, dig: str, times: Column) -> DataFrame:
        return (with_tree(rows.withColumn("next_text", F.col("d.text")), "next_text", "next_")
                .select(F.col(id_).alias("id"), F.col(dig).alias("dig"), begin.alias("begin"), "next_root", "next_marks", times.alias("times")))

    given = as_next(copies.join(asks, ["id", "dig"]), "to_id", "to_dig", one)
    # copies of one row: all but the last have a copy of themselves as next
    again = as_next(copies.where("copies > 1").withColumn("cut", F.floor(F.col("d.n") / 3)), "id", "dig", F.col("copies") - 1)
    x = copies.join(given.unionByName(again), ["id", "dig"]).select("d.*", "begin", "next_root", "next_marks", (F.col("times") * one).alias("times"))
    keep = (F.col("n") - F.floor(F.col("n") / 3)).cast("int")
    x = x.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), keep), "begin"))
    x = with_tree(with_tree(x, "text", "own_"), "edited", "edit_")
    x = x.select("doc_id", F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 fingerprint_text(F.col("own_root"), F.col("own_paragraphs")).alias("fingerprint"),
                 fingerprint_text(F.col("edit_root"), F.col("edit_paragraphs")).alias("edited_fingerprint"),
                 likeness(F.col("own_root"), F.col("own_marks"), F.col("edit_root"), F.col("edit_marks")).alias("near_edited"),
                 likeness(F.col("own_root"), F.col("own_marks"), F.col("next_root"), F.col("next_marks")).alias("near_next"), "times")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("times", "copy")


def _tree_sql(text: str) -> tuple[str, str, str]:
    """SQL for (paragraphs, root and marks of a text, given the paragraphs' name ``{p}``)."""
    q = PIECE.replace("'", "''")
    head = ", ".join(f"substr(p, {s}, {n})" for s, n in HEAD)
    pieces = (f"CASE WHEN i <= {HEAD_PARAGRAPHS} THEN list_concat(list_filter([{head}], lambda x: x <> ''), regexp_extract_all(substr(p, {HEAD_CHARS + 1}), '{q}')) "
              f"ELSE regexp_extract_all(p, '{q}') END")
    par = (f"list_transform(string_split({text}, chr(10)), lambda p, i: struct_pack(digest := sha256(p), blank := p = '', "
           f"marks := list_transform({pieces}, lambda x: substr(md5(x), 1, 10) || lpad(CAST(length(x) AS VARCHAR), 3, '0'))))")
    ends = "(p.blank OR substr(p.digest, 1, 1) IN ('0', '1'))"
    root_ = (f"sha256(array_to_string(list_transform(list_filter(string_split(array_to_string(list_transform({{p}}, lambda p: p.digest || CASE WHEN {ends} THEN '/' ELSE '' END), ''), '/'), "
             "lambda s: s <> ''), lambda s: sha256(s)), ''))")
    body = f"regexp_replace(array_to_string(list_transform({{p}}, lambda p: array_to_string(p.marks, '') || CASE WHEN {ends} THEN '/' ELSE '.' END), ''), '[./]$', '')"
    return par, root_, body


def edited_likeness_sql() -> str:
    """DuckDB's statement of ``edited_likeness`` on ``documents``."""
    _, root_, body = _tree_sql("")
    par = {c: _tree_sql(c)[0] for c in ("text", "edited", "next_text")}

    def weight(x: str) -> str:
        return f"coalesce(list_sum(list_transform({x}, lambda x: CAST(substr(x, 11, 3) AS BIGINT))), 0)"

    def like(a: str, b: str) -> str:
        total = f"({weight(f'{a}_marks')} + {weight(f'{b}_marks')})"
        return (f"CASE WHEN {a}_root = {b}_root THEN 1.0 WHEN {total} = 0 THEN 0.0 "
                f"ELSE CAST(2 * {weight(f'list_intersect({a}_marks, {b}_marks)')} AS DOUBLE) / {total} END")

    parts = ", ".join(f"{root_.format(p=f'{c}_p')} AS {c}_root, {body.format(p=f'{c}_p')} AS {c}_body, "
                      f"flatten(list_transform({c}_p, lambda p: p.marks)) AS {c}_all" for c in par)
    # the second and later ones of equal marks with their number
    numbered = ", ".join(f"list_transform({c}_all, lambda x, i: x || CASE WHEN list_position({c}_all, x) < i THEN "
                         f"'#' || CAST(len(list_filter(list_slice({c}_all, 1, i), lambda y: y = x)) AS VARCHAR) ELSE '' END) AS {c}_marks" for c in par)
    return f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST(length(text) // 3 AS BIGINT) AS cut, sha256(text) AS dig FROM s),
x AS (SELECT doc_id, text, n, cut, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, dig),
  first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, dig)) AS next_text FROM o),
e AS (SELECT doc_id, n, text, next_text, substr(text, 1, n - cut) || substr(next_text, 1, cut) AS edited FROM x),
t AS (SELECT doc_id, n, edited, {', '.join(f'{x} AS {c}_p' for c, x in par.items())} FROM e),
q AS (SELECT doc_id, n, edited, {parts} FROM t),
r AS (SELECT * EXCLUDE ({", ".join(f"{c}_all" for c in par)}), {numbered} FROM q)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, text_root || '/' || text_body AS fingerprint,
  edited_root || '/' || edited_body AS edited_fingerprint, CAST({like('text', 'edited')} AS DOUBLE) AS near_edited, CAST({like('text', 'next_text')} AS DOUBLE) AS near_next
FROM r"""
