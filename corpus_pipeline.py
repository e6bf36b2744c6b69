"""Corpus preparation as a chain of stages; each takes (spark, docs, sf_dir).

Rejected documents, all but the first of near duplicates, and documents that hold
a benchmark item go; the sources are then mixed to their target weights and the
mix is written as token ids. The last stage returns one row per document of the
mix, read back from the files.
"""

from __future__ import annotations

from quantweave.llm.base import read, staged
from quantweave.llm.decontam import keep_clean
from quantweave.llm.mixing import take
from quantweave.llm.quality import keep_good
from quantweave.llm.simhash import keep_first
from quantweave.llm.tokens import read_digests, write_ids
from quantweave.session import work_dir


def quality_rules(spark, docs, sf_dir):
    """Drops the documents that the base rule or a calibrated rule rejects."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates."""
    return keep_first(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drops documents with a window like a benchmark item."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Repeats or leaves out documents until every source has its share of the words."""
    return take(docs)


def token_output(spark, docs, sf_dir):
    """Writes the mix as token ids; returns doc_id, start, n_tokens and ids_crc32 from the files."""
    path = work_dir(spark, "corpus-ids")
    write_ids(docs, path)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("mixing", mixing), ("token_output", token_output)]

#: Fingerprints (XXH64), tokenizers and seeded rounding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
