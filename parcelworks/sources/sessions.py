"""Research sessions from a tree `range/job client/…/E Research/research.json`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECT = "struct<id:string,type:string,name:string,deed_saved:boolean,plat_saved:boolean,status:string,notes:string,deed_path:string,plat_path:string>"
SESSION = f"job_number string, client_name string, job_type string, subjects array<{SUBJECT}>, _corrupt_record string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row a research.json: job_number bigint, client_name, job_type, range_folder, subjects, file_date, file_path.

    Range folders that start with 00 are left out, as are files that can't be read.  Names come from the folders;
    subjects that lack flags count as not saved.  The newest job stands first.
    """
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "research.json").text(path)
    raw = text.select("_metadata", F.from_json("value", SESSION).alias("j")).select("_metadata", "j.*")
    file = F.url_decode(F.replace(F.col("_metadata")["file_path"], F.lit("+"), F.lit("%2B")))
    parts = F.split(file, "/")
    n = F.size(parts)
    at = lambda k: F.get(parts, n - k)
    rows = raw.select("*", file.alias("file_path"), F.to_date(F.col("_metadata")["file_modification_time"]).alias("file_date"), at(5).alias("range_folder"), at(4).alias("job_folder"), at(3).alias("type_folder"))
    rows = rows.filter("_corrupt_record IS NULL").filter(~F.col("range_folder").startswith("00"))
    job, kind = r"^(\d{4})\s+(.*)$", r"^\d+-01-([A-Z]+)\s"
    rows = rows.filter(F.col("job_folder").rlike(job))
    return rows.select(
        F.regexp_extract("job_folder", job, 1).cast("bigint").alias("job_number"),
        F.coalesce("client_name", F.regexp_extract("job_folder", job, 2)).alias("client_name"),
        F.coalesce("job_type", F.nullif(F.regexp_extract("type_folder", kind, 1), F.lit("")), F.lit("BDY")).alias("job_type"),
        F.coalesce("subjects", F.array().cast(f"array<{SUBJECT}>")).alias("subjects"),
        "range_folder", "file_date", "file_path",
    ).orderBy(F.desc("job_number"))


def next_job_number(sessions: DataFrame, floor: int = 2937) -> DataFrame:
    """One row: the next number and its range of a hundred."""
    top = sessions.agg(F.greatest(F.coalesce(F.max("job_number"), F.lit(0)) + 1, F.lit(floor)).alias("job_number"))
    return top.select("job_number", (F.floor(F.col("job_number") / 100) * 100).alias("range"))


def merge_subjects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions (job_number, subjects) with new subjects merged in by id: known ones field-wise, others at the end."""
    a = old.select("job_number", F.posexplode("subjects").alias("o", "s")).select("job_number", "o", F.col("s.id").alias("id"), "s")
    b = new.select("job_number", F.posexplode("subjects").alias("q", "t")).select("job_number", "q", F.col("t.id").alias("id"), "t")
    fields = [f.split(":")[0] for f in SUBJECT[7:-1].split(",")]
    both = a.join(b, ["job_number", "id"], "full_outer").select(
        "job_number", F.coalesce("o", F.lit(1_000_000) + F.col("q")).alias("place"),
        F.struct(*[F.coalesce(F.col(f"t.{f}"), F.col(f"s.{f}")).alias(f) for f in fields]).alias("subject"),
    )
    return both.groupBy("job_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "subject"))), lambda x: x["subject"]).alias("subjects"))


def mark_saved(sessions: DataFrame, subject_id: str, what: str = "deed", path: str | None = None) -> DataFrame:
    """Sets deed_saved or plat_saved, and the path, of one subject."""
    done = lambda s: s.withField(f"{what}_saved", F.lit(True)).withField(f"{what}_path", F.lit(path).cast("string"))
    return sessions.withColumn("subjects", F.transform("subjects", lambda s: F.when(s["id"] == subject_id, done(s)).otherwise(s)))
