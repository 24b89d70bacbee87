"""Lexicon look-up and text classification over word lists the caller supplies.

A lexicon is a table ``(lexicon, role, key)``.  Roles: ``target_a`` and ``target_b``
(the wanted lists, the first the cleaner one), ``major_a`` and ``major_b`` (big
competing lists), ``minor`` (small competing lists), and for the cascade also
``curated``, ``curated_second`` and ``negative``.  No word list ships with the package.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import name_key
from sitegauge.session import reliable

TOKEN_SPLIT = r"[\s'’,.\-]+"
MIN_KEY = 3
ROLES = ("target_a", "target_b", "major_a", "major_b", "minor", "curated", "curated_second", "negative")


def prepare_lexicon(titles: DataFrame) -> DataFrame:
    """Titles ``(lexicon, role, title)`` to distinct keys; service pages and phrases dropped.

    Each spelling is normalised once, however many lists and roles hold it.
    """
    one_word = ~F.col("title").contains(":") & ~F.trim("title").rlike(r"\s")
    spellings = titles.where(one_word).select("lexicon", "role", "title").distinct()
    keys = keyed_words(spellings.select("title").distinct(), "title")
    return spellings.join(keys, "title").select("lexicon", "role", "key").distinct()


def keyed_words(words: DataFrame, word: str) -> DataFrame:
    """(word, key) of distinct words whose key is long enough.

    The length test sits inside the exploded array: as a filter it would be moved below
    the projection and every word would be normalised twice.
    """
    long_enough = F.filter(F.array(name_key(F.col(word))), lambda k: F.length(k) >= MIN_KEY)
    return words.select(word, F.explode(long_enough).alias("key"))


def key_verdicts(lexicon: DataFrame) -> DataFrame:
    """One row per key: which roles hold it, and how exclusive that makes it."""
    has = [F.max(F.col("role") == role).alias(role) for role in ROLES]
    keyed = lexicon.groupBy("key").agg(*has)
    a, b = F.col("target_a"), F.col("target_b")
    big_a, big_b = F.col("major_a"), F.col("major_b")
    return keyed.withColumn(
        "verdict",
        F.when(a & ~big_a, "exclusive")
        .when(a & big_a, "shared")
        .when(b & big_a, "foreign")
        .when(b & ~big_b, "exclusive")
        .when(b & big_b, "shared")
        .when(big_a | big_b, "foreign")
        .when(F.col("minor"), "foreign")
        .otherwise("unknown"),
    )


def tokens_of(texts: DataFrame, id_col: str, text_col: str, normalise: bool = True) -> DataFrame:
    """(id, pos, key) of every word of every text.

    Words too short for a key are left in: they find nothing in a lexicon, and testing
    the key here would normalise every word twice.
    """
    words = F.split(F.col(text_col), TOKEN_SPLIT)
    out = texts.select(F.col(id_col), F.posexplode(words).alias("pos", "token"))
    return out.select(id_col, "pos", (name_key(F.col("token")) if normalise else F.lower("token")).alias("key"))


#: A lexicon of so many keys at most is sent to every task; a longer one is joined by shuffle.
BROADCAST_KEYS = 500_000
#: Keys that the count of frequent ones keeps track of; a key beyond that is not hot.
TRACKED = 10_000


def hot_keys(tokens: DataFrame) -> DataFrame:
    """(key, parts) of the keys that have more tokens than a task should: how many tasks to spread each over.

    The counts are a mergeable sketch of the most frequent keys, one aggregation over the tokens. At most one key for
    each shuffle partition can have more than its share, so the table is short. A count that is too high or too low
    changes the balance only, never the result.
    """
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = tokens.where("key is not null").agg(F.expr(f"approx_top_k(key, {min(n, 1000)}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    each = top.select(F.explode("top").alias("t"), "n")
    share = F.ceil(F.col("t.count") * n / F.col("n")).cast("int")
    return each.select(F.col("t.item").alias("key"), share.alias("parts")).where("parts > 1")


def lookup(tokens: DataFrame, keyed: DataFrame, most_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Inner join on ``key``; ``keyed`` has one row per key.

    A short ``keyed`` is broadcast, after its rows were counted. With a long one the hot keys of the tokens are measured,
    their tokens are dealt over as many tasks as their counts ask for, and their one row of ``keyed`` goes to each.
    """
    keyed = reliable(keyed)
    if keyed.limit(most_rows + 1).count() <= most_rows:
        return tokens.join(F.broadcast(keyed), "key")
    hot = F.broadcast(reliable(hot_keys(tokens)))
    parts = F.coalesce("parts", F.lit(1))
    turn = F.when(parts > 1, F.pmod(F.xxhash64(*tokens.columns), parts)).otherwise(0).cast("int")
    left = tokens.join(hot, "key", "left").withColumn("_part", turn).drop("parts")
    right = keyed.join(hot, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["key", "_part"]).drop("_part")


def text_verdicts(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                  normalise: bool = True, most_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Verdict of a whole text: exclusive wins, else the last shared word, else the first foreign one."""
    hits = lookup(tokens_of(texts, id_col, text_col, normalise), key_verdicts(lexicon).select("key", "verdict"), most_rows)
    spot = F.struct("pos", "key")
    v = F.col("verdict")
    best = hits.groupBy(id_col).agg(
        F.min(F.when(v == "exclusive", spot)).alias("e"),
        F.max(F.when(v == "shared", spot)).alias("s"),
        F.min(F.when(v == "foreign", spot)).alias("f"),
    )
    picked = best.select(
        id_col,
        F.when(F.col("e").isNotNull(), "exclusive").when(F.col("s").isNotNull(), "shared")
        .when(F.col("f").isNotNull(), "foreign").alias("verdict"),
        F.coalesce("e", "s", "f")["key"].alias("matched"),
    )
    return texts.select(id_col).join(picked, id_col, "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("unknown"))
    )


@dataclass(frozen=True)
class Cascade:
    """Rules of the text classification that are not in the lexicon."""

    business: bool = False
    block_words: Sequence[str] = ()
    negative_patterns: Sequence[str] = ()
    strong_suffix: str | None = None
    weak_suffix: str | None = None
    max_len: int | None = None
    min_len: int = field(default=3)

    @property
    def shortest(self) -> int:
        return 5 if self.business else self.min_len


def classify_texts(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, rules: Cascade,
                   most_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Ordered classification: (id, ok, strong, via).

    Curated words win over the lists, negative words come next, then the exclusivity
    verdict, and last the ending of the raw last word unless a big list holds it.
    """
    base = texts.select(id_col, F.trim(F.col(text_col)).alias("_text"))
    # Keys are made once for each distinct word and joined back to the words' places.
    spoken = base.select(id_col, F.posexplode(F.split("_text", TOKEN_SPLIT)).alias("pos", "word"))
    keys = keyed_words(spoken.select("word").distinct(), "word")
    tokens = spoken.join(keys, "word").select(id_col, "pos", "key")
    last = tokens.groupBy(id_col).agg(F.max("pos").alias("_last"))
    hits = lookup(tokens, key_verdicts(lexicon), most_rows).join(last, id_col)
    by_text = hits.groupBy(id_col).agg(
        F.max("curated").alias("curated"),
        F.max("curated_second").alias("curated_second"),
        F.max("negative").alias("negative"),
        F.max(F.col("verdict") == "exclusive").alias("exclusive"),
        F.max(F.col("verdict") == "shared").alias("shared"),
        F.max((F.col("pos") == F.col("_last")) & (F.col("major_a") | F.col("major_b"))).alias("vetoed"),
    )
    words = F.filter(F.split(F.col("_text"), TOKEN_SPLIT), lambda w: F.length(w) >= MIN_KEY)
    last_word = F.get(words, F.size(words) - 1)
    n = F.length("_text")
    too_long = n > rules.max_len if rules.max_len is not None else F.lit(False)
    blocked = F.lower("_text").isin(*[w.lower() for w in rules.block_words]) if rules.business and rules.block_words else F.lit(False)
    negative = F.lit(False)
    for pattern in rules.negative_patterns:
        negative = negative | F.col("_text").rlike(pattern)
    # What the cascade asks of a text, told where it is read: flags are joined, not texts.
    asked = base.select(
        id_col, ((n < rules.shortest) | too_long | F.col("_text").isNull() | blocked).alias("_none"), negative.alias("_negative"),
        (last_word.rlike(rules.strong_suffix) if rules.strong_suffix else F.lit(False)).alias("_strong_end"),
        (last_word.rlike(rules.weak_suffix) if rules.weak_suffix and not rules.business else F.lit(False)).alias("_weak_end"),
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    result = lambda ok, strong, via: F.struct(
        F.lit(ok).alias("ok"), F.lit(strong).alias("strong"), F.lit(via).alias("via")
    )
    no = result(False, False, "none")
    out = F.when(F.coalesce("_none", F.lit(True)), no).when(flag("curated"), result(True, True, "list"))
    if not rules.business:
        out = out.when(flag("curated_second"), result(True, True, "list"))
    out = (
        out.when(flag("_negative") | flag("negative"), no)
        .when(flag("exclusive"), result(True, True, "lexicon"))
        .when(flag("shared"), result(True, False, "lexicon-shared"))
        .when(~flag("vetoed") & flag("_strong_end"), result(True, True, "suffix"))
        .when(~flag("vetoed") & flag("_weak_end"), result(True, False, "suffix-weak"))
    )
    return (
        asked.join(by_text, id_col, "left")
        .withColumn("_r", out.otherwise(no))
        .select(id_col, "_r.ok", "_r.strong", "_r.via")
    )
