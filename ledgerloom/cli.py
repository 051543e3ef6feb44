"""python -m ledgerloom.cli basic | incremental | summary"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .ingest import Settings, run_ingest, run_summary
from .store import CatalogStore, ParquetStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom")
    jobs = top.add_subparsers(dest="job", required=True)
    for job in ("basic", "incremental", "summary"):
        p = jobs.add_parser(job)
        p.add_argument("--source-type", choices=["file", "rest"], default="file")
        for flag in ("source-file", "schema-file", "api-url", "catalog", "dataset", "transactions-table", "quarantine-table", "control-table"):
            p.add_argument(f"--{flag}", default=getattr(Settings, flag.replace("-", "_")))
        p.add_argument("--api-key", default=os.getenv("LEDGERLOOM_API_KEY"))
        p.add_argument("--warehouse", default="ledger-warehouse", help="root folder of Parquet tables, a folder for each data set")
        p.add_argument("--provider", help="use the catalog's tables of this format instead")
        if job == "incremental":
            p.add_argument("--watermark-table", default=Settings.watermark_table)
            p.add_argument("--source-name", default=Settings.source_name)
            p.add_argument("--lookback-hours", "--lookback-days", dest="lookback_hours", type=int, default=0, help="hours, under either name")
        if job == "summary":
            p.add_argument("--output-dataset", default=Settings.output_dataset, help="where the summary and its mark are written")
            p.add_argument("--sql-template", help="not supported: the summary is built from DataFrame expressions, and there is no template to replace")
            p.add_argument("--summary-by", choices=["transaction_date", "ingestion_timestamp"], default=Settings.summary_by)
            p.add_argument("--output-table", default=Settings.output_table)
            p.add_argument("--summary-watermark-table", default=Settings.summary_watermark_table)
    return top


def report(job: str, s: Settings, result: dict) -> str:
    width = max(map(len, result))
    return "\n".join([f"== {job}: {s.source_type} -> {s.catalog}.{s.dataset}", *(f"{k:<{width}} : {v}" for k, v in result.items())])


def stores(spark: SparkSession, s: Settings, warehouse: str, provider: str | None):
    """(the store of the data set, that of the summary's data set)."""
    if provider:
        return CatalogStore(spark, f"{s.catalog}.{s.dataset}", provider), CatalogStore(spark, f"{s.catalog}.{s.output_dataset}", provider)
    return ParquetStore(spark, f"{warehouse}/{s.dataset}"), ParquetStore(spark, f"{warehouse}/{s.output_dataset}")


def main(argv: list[str] | None = None) -> dict:
    top = parser()
    args = vars(top.parse_args(argv))
    if args.get("sql_template"):
        top.error("--sql-template is not supported: the summary is built from DataFrame expressions")
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s = Settings(**{k: v for k, v in args.items() if k in Settings.__dataclass_fields__})
    store, out = stores(spark, s, args["warehouse"], args["provider"])
    result = run_summary(spark, store, s, out=out) if args["job"] == "summary" else run_ingest(spark, store, s, args["job"] == "incremental")
    print(report(args["job"], s, result))
    return result


if __name__ == "__main__":
    main()
