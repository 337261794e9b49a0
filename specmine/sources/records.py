"""OCR output, fixture records, truth tables, manifests, taxonomy and scoreboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONFIDENCE = "struct<score:double,reason:string>"
FIXTURE = f"""
    id string, identity struct<manufacturer:string,model:string,shortName:string,categories:array<string>,confidence:{CONFIDENCE}>,
    physical struct<widthMm:double,heightMm:double,depthMm:double,weightKg:double,powerW:double,lensMinDegrees:double,lensMaxDegrees:double>,
    provenance struct<sourceType:string,sourceName:string,identityFromManual:boolean,importedAt:string,notes:array<string>>,
    channels array<struct<id:string,name:string,kind:string,gdtfAttribute:string,gdtfFeature:string,color:string,fineOf:string,wheelId:string,
      ranges:array<struct<start:int,end:int,name:string,capability:string,wheelSlot:int,safety:string,confidence:{CONFIDENCE}>>,confidence:{CONFIDENCE}>>,
    modes array<struct<id:string,name:string,shortName:string,breaks:int,channels:array<struct<channelId:string,offset:int,dmxBreak:int>>>>,
    wheels array<struct<id:string,name:string,kind:string,slots:array<struct<number:int,name:string,color:string>>>>,
    matrix struct<x:int,y:int,z:int,pixels:array<struct<id:string,x:int,y:int,z:int>>>,
    geometry struct<body:boolean,yoke:boolean,head:boolean,beam:boolean,pixelEmitters:boolean>"""


def parse_ocr_tsv(lines: DataFrame) -> DataFrame:
    """Word rows (level 5, 12 columns or more, not blank) of OCR TSV lines; the text may hold tabs."""
    c = F.split("value", "\t", 12)
    n = lambda i, t="int": F.get(c, F.lit(i)).try_cast(t)
    words = lines.where((n(0) == 5) & (F.size(c) >= 12)).withColumn("text", F.trim(F.get(c, F.lit(11)))).where("text <> ''")
    return words.select("doc_id", n(1).alias("page"), n(5).alias("word_no"), "text", n(6, "double").alias("x"), n(7, "double").alias("y"), n(8, "double").alias("width"), n(9, "double").alias("height"), n(10, "double").alias("confidence"))


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("doc_id"), "value")
    return parse_ocr_tsv(lines)


def flatten_ocr_blocks(df: DataFrame) -> DataFrame:
    """Nested blocks, paragraphs, lines and words as words; a flat ``words`` array wins."""
    nested = F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda x: x["words"]))))))
    words = F.when(F.size("words") > 0, F.col("words")).otherwise(nested)
    return df.select("doc_id", F.posexplode(words).alias("word_no", "w")).select("doc_id", "word_no", "w.text", "w.confidence")


def fill_fixture_defaults(fx: DataFrame) -> DataFrame:
    """Declared defaults for absent fields."""
    sure = F.struct(F.lit(1.0).alias("score"), F.lit("").alias("reason"))
    channel = lambda c: c.withField("kind", F.coalesce(c["kind"], F.lit("generic"))).withField("color", F.coalesce(c["color"], F.lit(""))).withField("ranges", F.coalesce(c["ranges"], F.array())).withField("confidence", F.coalesce(c["confidence"], sure))
    mode = lambda m: m.withField("breaks", F.coalesce(m["breaks"], F.lit(1))).withField("channels", F.coalesce(m["channels"], F.array()))
    none = lambda c: F.coalesce(F.col(c), F.array())
    return fx.withColumns({"channels": F.transform(none("channels"), channel), "modes": F.transform(none("modes"), mode), "wheels": none("wheels")})


def parse_fixtures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with defaults of (file, value), and the files that couldn't be parsed."""
    schema = f"{FIXTURE}, _corrupt_record string"
    raw = files.select("file", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("file", "r.*")
    bad = raw.where("_corrupt_record is not null or id is null").select("file", "_corrupt_record")
    return fill_fixture_defaults(raw.where("_corrupt_record is null and id is not null").drop("_corrupt_record", "file")), bad


def read_fixtures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records with defaults, and the files that couldn't be parsed."""
    return parse_fixtures(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def normalize_fixtures(fx: DataFrame) -> dict[str, DataFrame]:
    """The nested record as flat tables."""
    ch = fx.select(F.col("id").alias("doc_id"), F.posexplode("channels").alias("channel_idx", "c"))
    md = fx.select(F.col("id").alias("doc_id"), F.posexplode("modes").alias("mode_idx", "m"))
    wh = fx.select(F.col("id").alias("doc_id"), F.posexplode("wheels").alias("wheel_idx", "w"))
    return {
        "channels": ch.select("doc_id", "channel_idx", F.col("c.id").alias("channel_id"), "c.name", "c.kind", "c.color", F.col("c.fineOf").alias("fine_of"), F.col("c.wheelId").alias("wheel_id"), F.col("c.gdtfAttribute").alias("gdtf_attribute"), F.col("c.gdtfFeature").alias("gdtf_feature"), F.col("c.confidence.score").alias("confidence")),
        "ranges": ch.select("doc_id", F.col("c.id").alias("channel_id"), F.posexplode("c.ranges").alias("range_idx", "r")).select("doc_id", "channel_id", "range_idx", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"), "r.name", "r.safety", F.col("r.confidence.score").alias("confidence")),
        "modes": md.select("doc_id", "mode_idx", F.col("m.id").alias("mode_id"), "m.name", F.col("m.shortName").alias("short_name"), "m.breaks"),
        "assignments": md.select("doc_id", "mode_idx", F.posexplode("m.channels").alias("slot_idx", "a")).select("doc_id", "mode_idx", "slot_idx", F.col("a.channelId").alias("channel_id"), F.col("a.offset").alias("channel_offset"), F.col("a.dmxBreak").alias("dmx_break")),
        "wheels": wh.select("doc_id", "wheel_idx", F.col("w.id").alias("wheel_id"), "w.name", "w.kind"),
        "wheel_slots": wh.select("doc_id", F.col("w.id").alias("wheel_id"), F.posexplode("w.slots").alias("slot_idx", "s")).select("doc_id", "wheel_id", "slot_idx", "s.number", "s.name", "s.color"),
    }


def nest_fixtures(fixtures: DataFrame, channels: DataFrame, ranges: DataFrame, modes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Flat tables as one nested row for each document, arrays in index order."""
    of = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("_o"))
    r = ranges.groupBy("doc_id", "channel_id").agg(of(F.struct(F.col("range_idx").alias("_o"), F.col("range_start").alias("start"), F.col("range_end").alias("end"), "name", "safety", F.struct(F.col("confidence").alias("score")).alias("confidence"))).alias("ranges"))
    c = channels.join(r, ["doc_id", "channel_id"], "left").groupBy("doc_id").agg(of(F.struct(F.col("channel_idx").alias("_o"), F.col("channel_id").alias("id"), "name", "kind", "color", F.col("fine_of").alias("fineOf"), F.struct(F.col("confidence").alias("score")).alias("confidence"), F.coalesce("ranges", F.array()).alias("ranges"))).alias("channels"))
    a = assignments.groupBy("doc_id", "mode_idx").agg(of(F.struct(F.col("slot_idx").alias("_o"), F.col("channel_id").alias("channelId"), F.col("channel_offset").alias("offset"), F.col("dmx_break").alias("dmxBreak"))).alias("slots"))
    m = modes.join(a, ["doc_id", "mode_idx"], "left").groupBy("doc_id").agg(of(F.struct(F.col("mode_idx").alias("_o"), F.col("mode_id").alias("id"), "name", "breaks", F.coalesce("slots", F.array()).alias("channels"))).alias("modes"))
    return fixtures.join(c, "doc_id", "left").join(m, "doc_id", "left")


def read_truth(fixtures: DataFrame, modes: DataFrame, channels: DataFrame, functions: DataFrame, source: str = "library") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The truth tables of fixtures from one source; the filter reaches the scan."""
    f = fixtures.where(F.col("source") == source)
    m = modes.join(f.select("fixture_id"), "fixture_id", "left_semi")
    c = channels.join(m.select("mode_id"), "mode_id", "left_semi")
    return f, m, c, functions.join(c.select("channel_id"), "channel_id", "left_semi")


def read_truth_jdbc(spark: SparkSession, url: str, source: str = "library") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    table = lambda n: spark.read.jdbc(url, n)
    return read_truth(table("fixture"), table("mode"), table("channel"), table("chan_function"), source)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Pipe rows (line_no, value) to file and integer id or upper-cased GUID; the last row of a
    file wins; header, blank and unjoinable rows go."""
    parts = F.split("value", r"\|")
    last = F.trim(F.element_at(parts, -1))
    number = F.regexp_extract(last, r"^([0-9]+)\s*\(int id", 1).try_cast("bigint")
    guid = F.when(number.isNull() & last.rlike("^[0-9A-Fa-f-]{8,}$"), F.upper(last))
    rows = lines.where(F.size(parts) >= 2).select("line_no", F.trim(F.get(parts, F.lit(0))).alias("file"), guid.alias("guid"), number.alias("fixture_id")).where("file <> '' and lower(file) <> 'file' and (guid is not null or fixture_id is not null)")
    w = Window.partitionBy("file").orderBy(F.desc("line_no"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file", "guid", "fixture_id")


def read_taxonomy_xml(spark: SparkSession, path: str, control: str = "Control.Control") -> DataFrame:
    """Attribute definitions; pretty defaults to the name, feature to a control group."""
    df = spark.read.format("xml").option("rowTag", "Attribute").schema("_Name string, _Pretty string, _Feature string").load(path)
    return df.select(F.col("_Name").alias("name"), F.coalesce("_Pretty", "_Name").alias("pretty"), F.coalesce("_Feature", F.lit(control)).alias("feature"))


def write_fixture_json(df: DataFrame, path: str) -> None:
    """One JSON record a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def scoreboard_rows(board: DataFrame) -> DataFrame:
    """The board as it is written: doubles rounded to 4 places."""
    return board.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in board.dtypes])


def write_scoreboard(board: DataFrame, path: str) -> None:
    """CSV of the board's columns with a header."""
    scoreboard_rows(board).write.csv(path, header=True)


def extraction_summary(fixtures: DataFrame, modes: DataFrame, assignments: DataFrame) -> DataFrame:
    """A line for each document: maker, model and mode:footprint list; without modes it failed."""
    sizes = assignments.groupBy("doc_id", "mode_idx").agg(F.count_distinct("dmx_break", "channel_offset").alias("n"))
    listed = modes.join(sizes, ["doc_id", "mode_idx"]).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mode_idx", "name", "n"))), lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ", ").alias("footprints"))
    return fixtures.join(listed, "doc_id", "left").select("doc_id", "manufacturer", "model", F.coalesce("footprints", F.lit("")).alias("footprints"), F.col("footprints").isNull().alias("failed"))


def extraction_totals(summary: DataFrame) -> DataFrame:
    """How many documents of an extraction summary were read, and how many failed."""
    return summary.agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed"))
