"""One file per document: Markdown, zip archives, content-addressed images; destinations and their siblings."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def destination(folder_or_file: Column, source_name: Column) -> Column:
    stem = F.regexp_replace(source_name, r"\.[^.]*$", "")
    return F.when(folder_or_file.endswith("/"), F.concat(folder_or_file, stem, F.lit(".md"))).when(F.lower(folder_or_file).endswith(".md"), folder_or_file)


def sibling(md: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(md, r"(?i)\.md$", ""), F.lit(suffix))


def archive(name: str, content: str, summary: str | None, translations: dict[str, str] | None = None, images: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(f"{name}.md", content)
        if summary and summary.strip():
            z.writestr("summary.md", summary)
        for lang, text in (translations or {}).items():
            z.writestr(f"{name}.{lang}.md", text)
        for path, data in (images or {}).items():
            z.writestr(f"images/{path}", data)
    return out.getvalue()


def write_files(df: DataFrame, root: str, overwrite: bool = True) -> None:
    """(name, content) as files below root, a folder that all executors share; each appears whole or not at all."""

    def put(rows: Iterator) -> None:
        for row in rows:
            path = os.path.join(root, row["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            if not overwrite and os.path.exists(path):
                raise FileExistsError(f"destination_exists: {path}")
            part = f"{path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(row["content"])
            os.replace(part, path)

    df.select("name", "content").foreachPartition(put)


def new_images(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Images to write: one for each id that isn't stored."""
    return images.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def exposition(counts: DataFrame, name: str) -> DataFrame:
    """(labels map, value) as lines of text metrics."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return counts.select(F.concat(F.lit(name + "{"), labels, F.lit("} "), F.col("value").cast("string")).alias("line"))


def histogram_lines(row: DataFrame, name: str, bounds: list[int]) -> DataFrame:
    """A histogram (le_<bound>, n, total; one row) as lines of text metrics, its buckets cumulative."""
    pairs = [(f'{name}_bucket{{le="{b}"}} ', F.col(f"le_{b}")) for b in bounds] + [(f'{name}_bucket{{le="+Inf"}} ', F.col("n")), (f"{name}_count{{}} ", F.col("n")), (f"{name}_sum{{}} ", F.col("total"))]
    return row.select(F.explode(F.array(*[F.concat(F.lit(a), b.cast("string")) for a, b in pairs])).alias("line"))
