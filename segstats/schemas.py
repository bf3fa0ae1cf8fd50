"""Fixed schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

ANNOTATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("reference_tile", T.StringType()),
    T.StructField("segmentation", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("num_holes", T.LongType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("area", T.DoubleType()),
    T.StructField("role", T.StringType()),
])

ANNOTATIONS = T.ArrayType(ANNOTATION)

IMAGE_HEADER = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
])

ANNOTATION_FILE = T.StructType([
    T.StructField("image", IMAGE_HEADER),
    T.StructField("mode", T.StringType()),
    T.StructField("annotations", ANNOTATIONS),
])

TILE_MANIFEST = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("tile_file", T.StringType())])))

REVIEW_MANIFEST = T.StructType([
    T.StructField("pair_id", T.IntegerType()),
    T.StructField("real_filename", T.StringType()),
    T.StructField("synth_filename", T.StringType()),
    T.StructField("pair_image", T.StringType()),
])

METRIC = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
