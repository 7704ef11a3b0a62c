"""Files in and out: images, PDFs, truth tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp")
def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt over all cores, before work that costs much for each of them.

    A file of one row group is one task however it is split. Tables that fill the cores
    by their size stay as they are, so what is exchanged is bounded.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < split * cores else df


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, most_bytes: int = 25 << 20) -> DataFrame:
    """(path, length, content) of files below a folder, by suffix and size; the size is tested before contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & (F.col("length") <= most_bytes)).select("path", "length", "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (BGR) by Spark's own source; what cannot be decoded has a height of -1."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def is_pdf(content: Column) -> Column:
    """Its signature after white space, within the first 1024 bytes."""
    return F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^[\s\x00]+", "")).startswith("%PDF")


def unreadable(content: Column) -> Column:
    """Why bytes are no readable PDF; null if nothing says so."""
    raw = F.decode(content, "ISO-8859-1")
    return F.when(content.isNull() | (F.length(content) == 0), "vacio").when(~is_pdf(content), "formato").when(F.contains(raw, F.lit("/Encrypt")), "cifrado").when(~F.contains(raw, F.lit("%%EOF")), "corrupto")


def has_form(content: Column) -> Column:
    """A cheap test before form fields are looked for."""
    return F.contains(F.decode(content, "ISO-8859-1"), F.lit("/AcroForm"))


def has_signature(content: Column) -> Column:
    return F.contains(F.decode(content, "ISO-8859-1"), F.lit("/ByteRange"))


def to_page(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, turn: Column) -> Column:
    """A box in PDF points, from the bottom left, as fractions of the page as it is shown, from the top left."""
    flat = F.array(x0 / width, 1 - y1 / height, (x1 - x0) / width, (y1 - y0) / height)
    at = lambda i: F.get(flat, F.lit(i))
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return (
        F.when(turn == 90, box(1 - at(1) - at(3), at(0), at(3), at(2))).when(turn == 180, box(1 - at(0) - at(2), 1 - at(1) - at(3), at(2), at(3)))
        .when(turn == 270, box(at(1), 1 - at(0) - at(2), at(3), at(2))).otherwise(box(at(0), at(1), at(2), at(3)))
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of the truth, with ; or , between its columns, whichever its first 2048 signs hold more of (; on ties)."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(64).collect())[:2048]
    sep = ";" if head.count(";") >= head.count(",") else ","
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns]).where(F.trim(F.coalesce(F.col(df.columns[0].removeprefix("﻿").strip()), F.lit(""))) != "")


def read_truth_long(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, field, truth) of a CSV with a row for each field; the kind of a file is that of its first row."""
    t = read_truth(spark, path)
    t = t.select(*[F.trim(F.col(c)).alias(n) for c, n in zip(t.columns, ("file", "kind", "field", "truth"))]).withColumn("_n", F.monotonically_increasing_id())
    kinds = t.groupBy("file").agg(F.min_by("kind", "_n").alias("kind"))
    return t.drop("kind", "_n").join(kinds, "file").select("file", "kind", "field", "truth")


def write_report(df: DataFrame, path: str) -> None:
    """A CSV with ; between its columns; reports hold no personal values."""
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def export_report(parts: list[DataFrame], path: str) -> None:
    """One CSV file for a spreadsheet: ; between columns, a mark for UTF-8, and the columns of all parts in the order they are first seen.

    Tasks write the rows, without heads; their files are put one after the other under one
    head by the file system's own streams, so that no row passes through Python and the
    report may be of any size. An older report is replaced once the new one is whole.
    """
    columns = list(dict.fromkeys(c for p in parts for c in p.columns))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    spark = whole.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    work, new, target = place(f"{path}.parts"), place(f"{path}.new"), place(path)
    fs = target.getFileSystem(conf)
    head = ";".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ';"\n\r') else c for c in columns) + "\n"
    options = {"sep": ";", "header": False, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    whole.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).write.mode("overwrite").options(**options).csv(f"{path}.parts")
    out = fs.create(new, True)
    try:
        out.write(bytearray(("\ufeff" + head).encode()))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(work) if f.getPath().getName().startswith("part-")):
            rows = fs.open(place(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 20, False)
            finally:
                rows.close()
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(new, target)
    fs.delete(work, True)


def read_rules(path: str) -> tuple[tuple, ...]:
    """Quality rules of a thresholds file, for quality.rules(): zone, metric, sense, doubtful from, bad from, whether bad only warns.

    The file names zones, in them metrics, and their values as ``sense``/``sentido``,
    ``dudoso``, ``mal`` and ``solo_aviso``; two blanks deepen a level, or braces hold a metric's values.
    """
    out, zone, metric, values = [], None, None, {}

    def close() -> None:
        if metric is not None and values:
            out.append((zone, metric, values.get("sentido", values.get("sense", "max")), float(values["dudoso"]), float(values["mal"]), str(values.get("solo_aviso", "false")).lower() in ("true", "si", "yes")))

    with open(path, encoding="utf-8") as f:
        for line in f:
            text = line.split("#")[0].rstrip()
            if not text.strip():
                continue
            depth = (len(text) - len(text.lstrip(" "))) // 2
            name, _, rest = text.strip().partition(":")
            rest = rest.strip()
            if depth == 0:
                close()
                zone, metric, values = name, None, {}
            elif depth == 1:
                close()
                metric, values = name, {}
                if rest.startswith("{"):
                    values = {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in rest.strip("{}").split(","))}
            else:
                values[name] = rest
        close()
    return tuple(out)
