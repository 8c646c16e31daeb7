"""Result tables to storage."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """A result table as CSV with a header, or in another format."""
    df.write.mode(mode).options(**({"header": True} if format == "csv" else {})).format(format).save(path)


def append_report(df: DataFrame, path: str) -> None:
    """Add a report row to a growing table."""
    write_table(df, path, mode="append")


def publish(frames: dict[str, DataFrame], uri: str, stamp: str | None = None, format: str = "parquet") -> str:
    """Write each table to ``<uri>/model_<stamp>/<name>`` and return that folder. Executors write straight to
    the target; nothing is staged and copied."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    folder = f"{uri.rstrip('/')}/model_{stamp}"
    for name, df in frames.items():
        write_table(df, f"{folder}/{name}", format)
    return folder


