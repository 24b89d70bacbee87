"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

A line's leaf is its number of tokens and its leading tokens; tokens with digits are variable fields from the start.
Within a leaf, lines gather around the one that most documents have: those with enough equal tokens at equal places
share its template, in which the places that differ are variable. Templates that recur across documents are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegauge.llm.common import bounded, reliable

#: Leading tokens that choose the leaf, under the number of tokens.
DEPTH = 3
#: Shorter lines say too little and are left alone.
MIN_TOKENS = 4
#: Share of places with equal tokens that a line needs to join a template.
SIMILARITY = 0.7
#: Lines of a leaf looked at for centres in one round, in the first and at most in later ones; rounds go on until no line is open.
BATCH, LARGEST_BATCH = 4, 256
#: A template of so many documents is dropped.
MIN_DOCS = 3
FIELD = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, masked): every line of enough tokens, its tokens with digits masked, one blank between."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    blank = F.translate("line", "\t\r\x0b\x0c", "    ")
    words = F.array_remove(F.split(blank, " ", -1), "")
    plain = each.select("doc", "line_no", "line", F.explode(F.array(words)).alias("words")).where(F.size("words") >= MIN_TOKENS)
    joined = F.array_join("words", " ")
    digits = F.col("line").rlike("[0-9]")
    masked = F.when(digits, F.regexp_replace(joined, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(joined)
    return plain.select("doc", "line_no", F.explode(F.array(masked)).alias("masked"), F.size("words").alias("n"))


def _keyed(docs: DataFrame) -> DataFrame:
    leaf = F.md5(F.concat_ws(" ", F.col("n"), F.substring_index("masked", " ", DEPTH)))
    return _lines(docs).select("doc", "line_no", "masked", "n", F.md5("masked").alias("line_id"), leaf.alias("leaf"))


def _alike(a: Column, b: Column) -> Column:
    """Whether two arrays of one length have enough equal places."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a) >= SIMILARITY


def _centres(open_: DataFrame, batch: int) -> DataFrame:
    """(leaf, centres): of the first `batch` lines of each leaf, in order, those that are like no centre before them."""
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.col("n_docs").desc(), "line_id"))
    first = open_.withColumn("place", place).where(F.col("place") <= batch)
    lines = F.array_sort(F.collect_list(F.struct("place", "line_id", "tokens")))
    none = F.array().cast("array<struct<place:int,line_id:string,tokens:array<string>>>")
    add = lambda done, x: F.when(F.exists(done, lambda c: _alike(c["tokens"], x["tokens"])), done).otherwise(F.array_append(done, x))
    return first.groupBy("leaf").agg(lines.alias("lines")).select("leaf", F.aggregate("lines", none, add).alias("centres"))


def _with_others(open_: DataFrame) -> DataFrame:
    """The lines that share a piece with another line of their leaf; a line without is like no other.

    Lines that are alike differ in at most 3 of 10 places, so of one piece more than that, one is equal in both.
    """
    n = F.size("tokens")
    pieces = F.floor(n * 3 / 10).cast("int") + 1
    cut = lambda j: F.floor(j * (n - DEPTH) / pieces).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.xxhash64(j, F.slice("tokens", cut(j) + DEPTH + 1, cut(j + 1) - cut(j))))
    each = reliable(open_.select("leaf", "line_id", F.explode(hashes).alias("piece")))
    shared = reliable(each.groupBy("leaf", "piece").count().where("count > 1").select("leaf", "piece"))
    return open_.join(reliable(each.join(shared, ["leaf", "piece"], "left_semi").select("line_id").distinct()), "line_id", "left_semi")


def _gathered(lines: DataFrame) -> DataFrame:
    """(leaf, line_id, template_id) for rows (leaf, line_id, n_docs, tokens): which line each gathers around.

    The lines of a leaf are taken in order (most documents, then smaller MD5): one that is like no centre so far is a
    centre, and each line gathers around the first centre that it is like. A round settles all centres among the first
    lines that are open, so the last round leaves no line.
    """
    done, rest, batch = [], lines, BATCH
    while True:
        tried = rest.join(_centres(rest, batch), "leaf", "left")
        near = F.filter("centres", lambda c: _alike(c["tokens"], F.col("tokens")))
        tried = reliable(tried.select("leaf", "line_id", "n_docs", "tokens", F.get(near, F.lit(0))["line_id"].alias("template_id")))
        done.append(tried.where("template_id IS NOT NULL").select("leaf", "line_id", "template_id"))
        open_ = tried.where("template_id IS NULL").select("leaf", "line_id", "n_docs", "tokens")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rest = reliable(_with_others(open_))
        done.append(open_.join(rest, "line_id", "left_anti").select("leaf", "line_id", F.col("line_id").alias("template_id")))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        batch = min(4 * batch, LARGEST_BATCH)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line_no, template_id, n_docs): the lines to drop, one row each.

    docs: doc_id, text; other columns are ignored. Lines are numbered from 0 over the newline-split text. `template_id`
    is the MD5 of the masked line that the template gathered around, `n_docs` the number of documents that have the
    template. Null and empty texts have no lines; null ids are one document; a repeated row gives repeated rows, and
    counts as one document. Ties between centres go to the smaller MD5.

    Keys only (MD5 of leaf and line) are counted over all lines; texts are read a second time for the lines of leaves
    where there is something to gather, once for each distinct line.
    """
    keys = reliable(_keyed(docs).select("doc", "line_no", "line_id", "leaf"))
    by_line = reliable(keys.groupBy("leaf", "line_id").agg(F.count_distinct(F.coalesce("doc", F.lit(-(2**63)))).alias("n_docs")))
    leaves = by_line.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n_docs").alias("docs")).where(F.col("docs") >= min_docs)
    mixed = by_line.join(leaves.where("lines > 1").select("leaf"), "leaf", "left_semi")
    wanted = bounded(reliable(mixed.select("line_id")))
    masked = _keyed(docs).select("line_id", "masked").join(wanted, "line_id", "left_semi").groupBy("line_id").agg(F.first("masked").alias("masked"))
    gathered = _gathered(reliable(mixed.join(masked, "line_id").select("leaf", "line_id", "n_docs", F.split("masked", " ").alias("tokens"))))
    alone = by_line.join(leaves.where("lines = 1").select("leaf"), "leaf", "left_semi").select("leaf", "line_id", F.col("line_id").alias("template_id"))
    template = reliable(gathered.unionByName(alone).select("line_id", "template_id"))
    member = keys.join(template, "line_id").select("doc", "line_no", "template_id")
    counts = member.groupBy("template_id").agg(F.count_distinct(F.coalesce("doc", F.lit(-(2**63)))).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    # Stored: joined straight to its aggregation, a frequent template would stay whole in one task.
    return member.join(reliable(counts), "template_id").select(F.col("doc").alias("doc_id"), "line_no", "template_id", "n_docs")


def without_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with the recurring lines taken out of their texts. A document keeps its row, even with no line left."""
    gone = recurring_lines(docs, min_docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]), "left")
    kept = F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    return joined.select(*[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
