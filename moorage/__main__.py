"""python -m moorage FILE... [--json] [--form] [--out FOLDER] [--check] [--list-types]"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="moorage", description="Files to filled and verified forms.")
    parser.add_argument("files", nargs="*", help="files or folders, one level deep")
    parser.add_argument("--json", action="store_true", help="print the form's fields as JSON lines")
    parser.add_argument("--form", action="store_true", help="print the form's fields as a table")
    parser.add_argument("--out", help="folder for the result's tables, as Parquet")
    parser.add_argument("--check", action="store_true", help="only say what each file is and how much text it has")
    parser.add_argument("--list-types", action="store_true")
    args = parser.parse_args(argv)
    from .operators import schema
    from .plans import organize as plan
    from .session import get_spark
    from .sources import ingest

    spark = get_spark("moorage")
    if args.list_types:
        schema.spec_counts(schema.field_rows(spark)).where("type_id IS NOT NULL").orderBy("type_id").show(50, truncate=False)
        return 0
    if not args.files:
        parser.error("no files")
    docs = ingest.ingest(ingest.read_input_files(spark, args.files)).withColumn("draft_id", F.lit(1)).persist()
    if args.check:
        docs.select("source_id", "name", "kind", F.length("text").alias("chars"), "confidence", "warnings").orderBy("source_id").show(1000, truncate=80)
        return 0
    result = plan.organize(spark, docs)
    form = plan.form_state(spark, result).orderBy("at", "row", "inner")
    if args.json:
        for line in form.toJSON().toLocalIterator():
            print(line)
    elif args.form:
        form.select("title", "path", "label", "required", "filled", "value", "attention").show(200, truncate=60)
    else:
        result.types.show(truncate=False)
        result.completeness.show()
        result.issues.orderBy("severity", "path").show(100, truncate=80)
    if args.out:
        for name in ("documents", "types", "leaves", "provenance", "issues", "completeness", "gaps", "conflicts", "evidence", "verdicts"):
            getattr(result, name).write.mode("overwrite").parquet(f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
