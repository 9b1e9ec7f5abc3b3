"""Writing reports: appended tables instead of rewritten files.

Reports are appended to a table partitioned by attack, so writers do not overwrite
each other. Arrays (ROC, individual scores) go to side tables by log_id and run.
"""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.functions.exprs import finite_or_null


def sanitised(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in floating columns and arrays of them."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = finite_or_null(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.transform(f"`{f.name}`", finite_or_null)
    return df.withColumns(out) if out else df


def report_rows(metrics: DataFrame, attack: str, log_id: str, run: str, metadata: dict | None = None, drop: list[str] | None = None) -> DataFrame:
    """(attack_name, log_id, run, metadata, instance): metrics as JSON, one row of each run."""
    body = sanitised(metrics.drop(*(drop or [])))
    fields = [F.col(f"`{c}`") for c in body.columns if c != run]
    extra = F.lit(None).cast("string") if not metadata else F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]))
    return body.select(F.lit(attack).alias("attack_name"), F.lit(log_id).alias("log_id"), F.col(run).cast("string").alias("run"), extra.alias("metadata"), F.to_json(F.struct(*fields)).alias("instance"))


def append_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("attack_name").parquet(path)


def write_side_table(arrays: DataFrame, path: str, log_id: str) -> None:
    """ROC vertices or individual scores, by log_id."""
    arrays.withColumn("log_id", F.lit(log_id)).write.mode("append").parquet(path)


def read_reports(spark: SparkSession, path: str, attacks: list[str] | None = None) -> DataFrame:
    """Appended reports; the filter prunes partitions."""
    out = spark.read.parquet(path)
    return out.filter(F.col("attack_name").isin(*attacks)) if attacks else out


def write_csv(df: DataFrame, path: str) -> None:
    """A matrix as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def text_report(metrics: DataFrame, title: str, columns: list[str], max_rows: int = 1_000) -> str:
    """A plain-text table of a small frame; more rows than max_rows are an error."""
    rows = metrics.select(*columns).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a text report of more than {max_rows} rows")
    cells = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    widths = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(columns), *map(line, cells)])


def pdf_report(text: str, path: str, lines_per_page: int = 60) -> None:
    """A plain-text report as a PDF file of fixed-width pages, written without other libraries; signs beyond Latin-1 become ?."""
    lines = text.split("\n")
    pages = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)]
    escaped = lambda t: t.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        body = b"BT /F1 8 Tf 10 TL 40 800 Td " + b" ".join(b"(" + escaped(line) + b") Tj T*" for line in page) + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, content in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, content)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    Path(path).write_bytes(bytes(out))


def release_files(folder: str, release: str, keep: tuple[str, ...] = (".json", ".txt", ".pdf")) -> list[str]:
    """Move the report files of a folder to the release folder; other files stay. The names moved come back, sorted."""
    source, target = Path(folder), Path(release)
    target.mkdir(parents=True, exist_ok=True)
    moved = sorted(p.name for p in source.iterdir() if p.is_file() and p.suffix in keep)
    for name in moved:
        shutil.move(source / name, target / name)
    return moved
