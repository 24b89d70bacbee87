"""Facts of pages stored by content: a page that was read once, by the same rules, is not read again.

A store is a folder of the caller's choice, with one Parquet table for each version of the rules. Its rows are keyed by
the digest of all that the facts are made from, so places that answer with equal pages share a row, and a re-score
parses only the pages whose digest it has not met.
"""

from __future__ import annotations

from hashlib import sha1

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.params import DEFAULT, Preset
from sitegauge.plans.rescore import page_facts
from sitegauge.session import bounded, reliable, spread

#: Goes up with every change of what a fact means; stored facts of another number are not read.
RULES = 1


def rules_version(preset: Preset = DEFAULT) -> str:
    """Names the rules and all their parameters."""
    return sha1(f"{RULES}|{preset!r}".encode()).hexdigest()[:16]


def content_key(responses: DataFrame) -> Column:
    """Digest of a stored answer, but for the place it belongs to. Null and empty values differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(responses.columns) if c != "place_id"]
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*sized).cast("binary"), 256)


def _known(responses: DataFrame, folder: str) -> DataFrame | None:
    try:
        return responses.sparkSession.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def facts_by_content(responses: DataFrame, path: str, preset: Preset = DEFAULT) -> DataFrame:
    """:func:`page_facts` of stored home pages, out of the store at ``path``; pages it lacks are parsed and added first.

    Bodies are read once for their digests and, where new, once for their facts. Only digests, places and facts are
    joined; bodies are moved only where the list of new pages is too long to broadcast and not all pages are new.
    Two runs may add the same page at the same time; it then counts once.
    """
    folder = f"{path}/rules={rules_version(preset)}"
    keys = reliable(responses.select("place_id", content_key(responses).alias("content_key")))
    known = _known(responses, folder)
    fresh = keys if known is None else keys.join(known.select("content_key"), "content_key", "left_anti")
    # One place stands for all that answer with the same page.
    fresh = reliable(fresh.groupBy("content_key").agg(F.min("place_id").alias("place_id")))
    n = fresh.count()
    if n:
        pages = responses
        if n < keys.count():
            pages = responses.join(bounded(fresh.select("place_id")), "place_id", "left_semi")
        facts = page_facts(spread(pages), preset)
        # The facts are written before the key is joined to them: no filter moves down to the scan.
        keyed = reliable(facts).join(fresh, "place_id").drop("place_id")
        keyed.write.mode("append").parquet(folder)
        known = _known(responses, folder)
    if known is None:
        return page_facts(responses.limit(0), preset)
    return keys.join(known.dropDuplicates(["content_key"]), "content_key").drop("content_key")
