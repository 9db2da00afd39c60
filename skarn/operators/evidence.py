"""Evidence behind claims: proof chains, bibliographies and rechecks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doi_of(paper_id: str) -> F.Column:
    """The DOI under which a paper without one is cited."""
    return F.concat(F.lit("10.1000/"), F.col(paper_id).cast("string"))


def proof_chains(claims: DataFrame, fingerprints: DataFrame, statements: DataFrame) -> DataFrame:
    """(claim_id, paper_id, content_sha256, doi, verification_id, verified): claim to fingerprint to statement.

    The last version of each claim counts; its fingerprint is the first of the paper it cites (or of its own id), else
    the first of all; the statement is the one whose id the claim names.
    """
    last = claims.groupBy("claim_id").agg(F.max_by(F.struct("citation_fingerprint_id", "verification_uuid"), "seq").alias("c")).select("claim_id", "c.*")
    first = fingerprints.groupBy("paper_id").agg(F.min_by("content_sha256", "seq").alias("content_sha256"))
    other = fingerprints.agg(F.min_by(F.struct("paper_id", "content_sha256"), "seq")).first()[0] or (None, None)
    wanted = F.coalesce("citation_fingerprint_id", "claim_id")
    found = last.withColumn("wanted", wanted).join(first, F.col("wanted") == first["paper_id"], "left")
    found = found.select("claim_id", "verification_uuid", F.coalesce("paper_id", F.lit(other[0])).alias("paper_id"), F.coalesce("content_sha256", F.lit(other[1])).alias("content_sha256"))
    ids = statements.select(F.col("id").alias("verification_id")).distinct()
    found = found.join(ids, found["verification_uuid"] == ids["verification_id"], "left")
    return found.select("claim_id", "paper_id", "content_sha256", doi_of("paper_id").alias("doi"), "verification_id", F.col("verification_id").isNotNull().alias("verified"))


def bibliography(fingerprints: DataFrame, dois: DataFrame) -> DataFrame:
    """(paper_id, doi, content_sha256) of each fingerprint; papers without a DOI get a made one."""
    known = dois.groupBy("paper_id").agg(F.min("doi").alias("doi"))
    return fingerprints.join(known, "paper_id", "left").select("paper_id", F.coalesce("doi", doi_of("paper_id")).alias("doi"), "content_sha256")


def bibtex(entries: DataFrame) -> DataFrame:
    return entries.select("paper_id", F.format_string("@article{p%d,\n  doi = {%s},\n  note = {sha256:%s}\n}", "paper_id", "doi", "content_sha256").alias("entry"))


def recheck(fingerprints: DataFrame, overrides: DataFrame, papers: DataFrame, statements: DataFrame, fetched: DataFrame) -> DataFrame:
    """(paper_id, source, status): fingerprints against what their sources hold now.

    A source is the override's, else the paper's, else the statement's, the first of each (``paper_id, url, seq``).
    ``fetched`` (url, content_sha256, retracted) is what was read; nothing read is ``unreachable``.
    """
    out = fingerprints
    for name, table in (("o", overrides), ("p", papers), ("s", statements)):
        first = table.groupBy("paper_id").agg(F.min_by("url", "seq").alias(f"_{name}"))
        out = out.join(first, "paper_id", "left")
    now = fetched.select("url", F.col("content_sha256").alias("_now"), F.col("retracted").alias("_retracted"))
    out = out.withColumn("url", F.coalesce("_o", "_p", "_s")).join(now, "url", "left")
    status = F.when(F.col("_now").isNull() & F.col("_retracted").isNull(), "unreachable").when(F.col("_retracted"), "retracted").when(F.col("_now") == F.col("content_sha256"), "unchanged").otherwise("changed")
    return out.select("paper_id", F.col("url").alias("source"), status.alias("status"))


def recheck_marks(checked: DataFrame) -> DataFrame:
    """Needs-review marks for what did not stay unchanged."""
    return checked.filter("status <> 'unchanged'").select(F.lit(12).alias("target_tile_type"), F.col("paper_id").alias("record_index"), F.lit(2).alias("mark_kind"), F.lit(1).alias("set_or_clear"))
