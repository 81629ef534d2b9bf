"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all that its predecessor kept; all but the
last return the columns of documents.  A runner writes each stage's result as Parquet and reads it back for the next.
"""

from __future__ import annotations

from parcelworks.llm import decontaminate, language, lines, near_duplicates, packing
from parcelworks.llm.common import stored, table


def identify_language(spark, docs, sf_dir):
    """Drops texts without a letter and those that no language profile is near to.

    Null and empty texts have no letter and go, with or without a doc_id; profiles are learnt from rows with a lang, and
    without any all rows go.  Ties between languages go to the first by name.  Repeated rows are judged each for itself,
    long texts as wholes.  An empty table stays empty; further columns, whatever their names, stay.
    """
    return language.keep_identified(docs)


def drop_repeated_lines(spark, docs, sf_dir):
    """Drops the boilerplate lines of each source.

    Null texts stay null and empty ones empty; rows without a source keep all lines; a line on just the ratio of the pages
    stays; repeated rows are pages each.  A page of boilerplate alone stays whole.  An empty table stays empty; further
    columns stay, n_chars follows the text.
    """
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group.

    Null, empty and wordless texts are linked with nothing and stay.  Rows without a doc_id come after all others; of rows
    alike in doc_id and text one stays.  Texts of any length are compared as wholes; a pair at just the threshold is
    linked.  An empty table stays empty; further columns stay.
    """
    return near_duplicates.keep_first(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents of which benchmark passages make up 5 per cent or more.

    Null and empty texts are clean.  Every row is judged by its own text, whatever its doc_id; just 5 per cent goes.  Items
    without words or id find nothing.  An empty table, or an empty benchmark, drops nothing; further columns stay.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Packs the rest into sequences, a row a piece; see packing.packed for its columns.

    Null and empty texts are their end token alone; repeated rows are packed each for itself; documents over 1,024 tokens
    are cut; pieces of one length take places in the order in which tasks met them.  An empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: No SQL: learnt profiles, sketches and packing are held against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's result written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
