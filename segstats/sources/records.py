"""Image records and annotations: parquet, local JSON folders, tile manifests, JSON output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segstats.functions.scalar import byte_luma, let
from segstats.schemas import ANNOTATION, ANNOTATION_FILE, ANNOTATIONS, TILE_MANIFEST


def read_records(spark: SparkSession, path: str, config: str | None = None, split: str | None = "train",
                 max_records: int = 0) -> DataFrame:
    """Records of one config and split; both are partition columns where the writer made them so.

    ``max_records`` keeps the first records by index (needs ``record_id``).
    """
    df = spark.read.parquet(path)
    for name, wanted in (("config", config), ("split", split)):
        if wanted is not None and name in df.columns:
            df = df.where(F.col(name) == wanted)
    return df.orderBy("record_id").limit(max_records) if max_records else df


def parse_annotation_list(elements: Column) -> Column:
    """Struct (good: annotations, bad: texts of the elements that do not fit the schema) of a list of JSON texts.

    Every element is parsed once; give the struct a name before its fields are used.
    """
    marked = T.StructType([*ANNOTATION.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.transform(elements, lambda e: F.struct(F.from_json(e, marked, {"columnNameOfCorruptRecord": "_corrupt"}).alias("a"), e.alias("e")))
    fits = lambda p: p["a"].isNotNull() & p["a"]["_corrupt"].isNull() & p["e"].startswith("{")
    good = lambda all_: F.transform(F.filter(all_, fits), lambda p: F.struct(*[p["a"][n].alias(n) for n in ANNOTATION.fieldNames()]))
    bad = lambda all_: F.transform(F.filter(all_, lambda p: ~F.coalesce(fits(p), F.lit(False))), lambda p: F.coalesce(p["e"], F.lit("null")))
    return let(parsed, lambda all_: F.struct(good(all_).alias("good"), bad(all_).alias("bad")))


def normalise_annotations(records: DataFrame, col: str = "annotations") -> DataFrame:
    """Annotations as an array of structs, whether stored as JSON text or parsed.

    Text that is no list gives NULL annotations and stays in ``bad_annotations``.
    Of a list, the elements that do not fit the schema (no object, or a field of
    another type) go there as a JSON list of texts, and the others are kept.
    """
    kind = records.schema[col].dataType
    if isinstance(kind, T.StringType):
        elements = F.when(F.ltrim(F.col(col)).startswith("["), F.from_json(F.col(col), "array<string>"))
        listed = records.withColumn("_elements", elements).withColumn("_parsed", parse_annotation_list(F.col("_elements")))
        bad = F.col("_parsed.bad")
        rejected = F.when(F.col(col).isNotNull() & F.col("_elements").isNull(), F.col(col)).when(F.size(bad) > 0, F.to_json(bad))
        return listed.withColumns({"bad_annotations": rejected, col: F.col("_parsed.good")}).drop("_elements", "_parsed")
    have = {f.name: f.dataType for f in kind.elementType.fields}

    def conform(a: Column) -> Column:
        return F.struct(*[(a[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOTATIONS.elementType.fields])

    return records.withColumns({"bad_annotations": F.lit(None).cast("string"), col: F.transform(F.col(col), conform)})


def explode_annotations(records: DataFrame, *keep: str, col: str = "annotations", category_default: str = "pattern",
                        role_default: str = "unknown") -> DataFrame:
    """One row per annotation with its place in the list; missing names and roles get their defaults."""
    rows = records.select(*keep, F.posexplode(col).alias("ann_idx", "_a")).select(*keep, "ann_idx", "_a.*")
    return rows.withColumns({"category_name": F.coalesce("category_name", F.lit(category_default)),
                             "role": F.coalesce("role", F.lit(role_default))})


def explode_rings(annotations: DataFrame, *keep: str, col: str = "segmentation") -> DataFrame:
    """One row per ring; ring 0 is the outline."""
    return annotations.select(*keep, F.posexplode(col).alias("ring_idx", "ring"))


def read_annotation_files(spark: SparkSession, root: str) -> DataFrame:
    """``annotations/*.json`` of a local data set: file_name, width, height, mode, annotations, source_file."""
    docs = spark.read.schema(ANNOTATION_FILE).json(f"{root}/annotations/*.json", multiLine=True)
    return docs.select("image.file_name", "image.width", "image.height", "mode", "annotations",
                       F.input_file_name().alias("source_file"))


def read_local_records(spark: SparkSession, root: str) -> DataFrame:
    """Annotation files with the bytes of their picture in ``images/``; ``picture_missing`` marks files whose picture is not there."""
    docs = read_annotation_files(spark, root)
    files = spark.read.format("binaryFile").load(f"{root}/images").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("content").alias("image"))
    return docs.join(files, "file_name", "left").withColumn("picture_missing", F.col("image").isNull())


def read_synth_listing(spark: SparkSession, root: str) -> DataFrame:
    """file_name and mode of every picture in ``images/`` in name order; mode is "unknown" without an annotation file."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{root}/images").select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    docs = read_annotation_files(spark, root).select(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.json$", "").alias("_stem"), "mode")
    listed = names.withColumn("_stem", stem).join(docs, "_stem", "left")
    return listed.select("file_name", F.coalesce("mode", F.lit("unknown")).alias("mode")).orderBy("file_name")


def sorted_files(annotation_files: DataFrame, limit: int) -> DataFrame:
    """The first files in lexical order."""
    return annotation_files.orderBy("source_file").limit(limit)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (file_name, y, x, r, g, b, gray) of a folder of pictures; :func:`unreadable_pictures` names the others.

    Spark decodes the files; the bytes of a picture (row by row, blue first)
    are unpacked in Arrow batches where they are.
    """
    pictures = _pictures(spark, path).where(F.col("width") > 0)
    schema = "file_name string, y int, x int, r int, g int, b int"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rec in batch.itertuples(index=False):
                flat = np.frombuffer(rec.data, dtype=np.uint8).reshape(rec.height, rec.width, rec.nChannels).astype(np.int32)
                blue, green, red = (flat[..., 0], flat[..., 1], flat[..., 2]) if rec.nChannels >= 3 else (flat[..., 0],) * 3
                rows = max(1, 1_000_000 // rec.width)
                for top in range(0, rec.height, rows):
                    part = slice(top, min(top + rows, rec.height))
                    y, x = np.mgrid[part, 0:rec.width]
                    yield pd.DataFrame({"file_name": rec.file_name, "y": y.ravel(), "x": x.ravel(), "r": red[part].ravel(),
                                        "g": green[part].ravel(), "b": blue[part].ravel()})

    return pictures.mapInPandas(unpack, schema).withColumn("gray", byte_luma(F.col("r"), F.col("g"), F.col("b")))


def _pictures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").load(path).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("file_name"), "image.width", "image.height", "image.nChannels", "image.data")


def unreadable_pictures(spark: SparkSession, path: str) -> DataFrame:
    """file_name of the files that are no picture Spark can decode."""
    return _pictures(spark, path).where(~(F.col("width") > 0)).select("file_name")


def read_tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tiles numbered from 1 in the order of the manifest: category_id, image_key, pattern_key, tile_file."""
    return parse_tile_manifest(spark.read.text(path, wholetext=True))


def parse_tile_manifest(text: DataFrame, col: str = "value") -> DataFrame:
    parsed = F.from_json(F.col(col), TILE_MANIFEST)
    images = text.select(F.posexplode(F.map_entries(parsed)).alias("_i", "_image"))
    tiles = images.select("_i", F.col("_image.key").alias("image_key"), F.posexplode(F.map_entries("_image.value")).alias("_p", "_tile"))
    named = tiles.select("_i", "_p", "image_key", F.col("_tile.key").alias("pattern_key"), F.col("_tile.value.tile_file").alias("tile_file"))
    # The manifest is one document, so its entries are numbered inside it.
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("_i", "_p")
    return named.select(F.row_number().over(order).alias("category_id"), "image_key", "pattern_key", "tile_file")


def annotation_documents(annotations: DataFrame, headers: DataFrame) -> DataFrame:
    """One document {image, mode, annotations} per image, as a table ready to be written.

    A document is one value, so its list holds all annotations of the image, in
    the order of ``ann_idx`` where there is one and of ``id`` otherwise.
    """
    place = "ann_idx" if "ann_idx" in annotations.columns else "id"
    body = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANNOTATIONS.elementType.fields])
    entry = F.struct(F.col(place).alias("place"), F.col("id").alias("id"), body.alias("body"))
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    docs = annotations.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(entry), by_place), lambda e: e["body"]).alias("annotations"))
    # Images without annotations still get their document.
    whole = headers.join(docs, "image_id", "left")
    return whole.select("image_id", F.struct("file_name", "width", "height").alias("image"), "mode",
                        F.coalesce("annotations", F.array().cast(ANNOTATIONS)).alias("annotations"))


def write_annotations(documents: DataFrame, path: str, fmt: str = "json", compression: str = "none") -> None:
    """Documents partitioned by mode, many to a file."""
    documents.withColumn("mode_dir", F.col("mode")).write.mode("overwrite").option("compression", compression).partitionBy("mode_dir").format(fmt).save(path)
