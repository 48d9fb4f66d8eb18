"""Sources (SURVEY S): CSV feeds, bracket documents, HTML and text scans, and a registry of collectors.

Readers give explicit schemas, turn the empty string into null, and an absent file into an empty table. Scans of pages
take a DataFrame of (id, text) so that any number of pages is parsed in parallel; nothing is fetched here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BRACKET = (
    "file string, title_line string, pages array<struct<page: int, matches: array<struct<id: int, tree: int, col: int, ncol: int, date: string,"
    " slot1: struct<leaf: string, `from`: int>, slot2: struct<leaf: string, `from`: int>, winner_slot: int, score1: int, score2: int, pk1: int, pk2: int,"
    " parent: int, parent_slot: int, notes: array<string>, match_no: string, team1: string, team2: string>>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns with a header; a byte-order mark is ignored, empty cells are null, no file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("enforceSchema", "true").csv(path, header=True, encoding="UTF-8", nullValue="", emptyValue="", multiLine=True, escape='"')


def read_csv_numbered(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: the same with `src_row`, the 1-based physical row; the number counts rows that are filtered later."""
    df = read_csv(spark, path, columns)
    schema = T.StructType([*df.schema.fields, T.StructField("src_row", T.LongType())])
    return spark.createDataFrame(df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1)), schema)


def read_brackets(spark: SparkSession, path: str) -> DataFrame:
    """One row per match of every bracket document; a slot is a leaf or the match it comes from."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, page int, id int, team1 string, team2 string, winner_slot int, score1 int, score2 int")
    docs = spark.read.schema(BRACKET).json(path, multiLine=True).withColumn("source", F.input_file_name())
    pages = docs.select("file", "source", F.explode("pages").alias("p"))
    return pages.select("file", F.col("p.page").alias("page"), F.explode("p.matches").alias("m")).select("file", "page", "m.*")


class _Tables(HTMLParser):
    """Cells of all tables of a page: (table, row, list of texts)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.table, self.row, self.cells, self.cell = [], 0, 0, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, 0
        elif tag == "tr":
            self.row, self.cells = self.row + 1, []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            self.rows.append((self.table, self.row, self.cells))
            self.cells = None


def html_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, row, cells) of every table row; broken markup gives what can be read."""
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, text in zip(f[key], f[html], strict=True):
                parser = _Tables()
                if isinstance(text, str):
                    parser.feed(text)
                    parser.close()
                out += [(k, t, r, c) for t, r, c in parser.rows]
            yield pd.DataFrame(out, columns=[key, "tab", "row", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, tab int, row int, cells array<string>")


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = r"/score/\d+") -> DataFrame:
    """Anchors whose target matches."""
    hit = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*href=["']([^"']+)["'][^>]*>"""), 1)
    return pages.select(key, F.explode(hit).alias("href")).where(F.col("href").rlike(pattern))


def cross_table(rows: DataFrame, key: str, name: str, cells: str, order: str) -> DataFrame:
    """Matches of a cross table: cell (i, j) for j > i, with whether (j, i) mirrors it."""
    w = Window.partitionBy(key).orderBy(order)
    n = rows.withColumn("i", F.row_number().over(w) - 1)
    long = n.select(key, "i", F.col(name).alias("home"), F.posexplode(cells).alias("j", "cell"))
    score = F.regexp_extract_all("cell", F.lit(r"(\d+)"), 1)
    long = long.withColumn("s", score).where(F.size("s") == 2).select(key, "i", "j", "home", F.get("s", F.lit(0)).cast("int").alias("x"), F.get("s", F.lit(1)).cast("int").alias("y"))
    names = n.select(key, F.col("i").alias("j"), F.col(name).alias("away"))
    mirror = long.select(key, F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("my"), F.col("y").alias("mx"))
    return long.where("j > i").join(names, [key, "j"]).join(mirror, [key, "i", "j"], "left").select(
        key, "i", "j", "home", "away", "x", "y", F.when(F.col("mx").isNotNull(), (F.col("x") == F.col("mx")) & (F.col("y") == F.col("my"))).alias("mirrored")
    )


def sextets(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Flat lines in groups of six, each group opened by a date; lines out of step are skipped by resynchronising."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.col(text).rlike(r"^\d{1,2}/\d{1,2}")
    parts = {f"f{k}": F.lead(text, k).over(w) for k in range(6)}
    x = lines.withColumns(parts).where(starts)
    return x.where(F.col("f2").rlike(r"^\d+$") & F.col("f3").rlike(r"^\d+$")).select(key, *[F.col(f"f{k}") for k in range(6)])


def year_rollover(cards: DataFrame, key: str, order: str, month: str, first_year: int) -> DataFrame:
    """The year of a list of cards: a month more than six below the one before opens a new year."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(month).over(w) - F.col(month)) > 6, F.lit(False)).cast("int")
    return cards.withColumn("_new", new).withColumn("year", F.lit(first_year) + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def ranked_text(text: str) -> list[tuple[int, int | None, str]]:
    """S16: "1位 [12]：甲 2位：乙" by always looking for the next expected rank; names may hold digits."""
    out, at, rank = [], 0, 1
    while True:
        m = re.compile(rf"(?<!\d){rank}位\s*(?:\[(\d+)\])?\s*[：:]\s*").search(text, at)
        if not m:
            return out
        after = re.compile(rf"(?<!\d){rank + 1}位\s*(?:\[\d+\])?\s*[：:]").search(text, m.end())
        name = text[m.end() : after.start() if after else len(text)].strip(" 　、,")
        out.append((rank, int(m.group(1)) if m.group(1) else None, name))
        at, rank = m.end(), rank + 1


def ranked_texts(lines: DataFrame, key: str, text: str) -> DataFrame:
    split = F.udf(lambda s: ranked_text(s) if s else [], "array<struct<rank: int, points: int, team: string>>", useArrow=True)
    return lines.select(key, F.explode(split(text)).alias("x")).select(key, "x.*")


def unpivot_groups(wide: DataFrame, keep: list[str], category: str, groups: dict[str, list[str]], names: list[str]) -> DataFrame:
    """The category column says which group of columns holds the record."""
    case = None
    for value, cols in groups.items():
        s = F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
        case = F.when(F.col(category) == value, s) if case is None else case.when(F.col(category) == value, s)
    return wide.select(*keep, category, case.alias("g")).where("g is not null").select(*keep, category, "g.*")


def archive_index(lines: DataFrame, text: str = "value") -> DataFrame:
    """Two-column index lines to (ts, url, kind)."""
    ts, url = F.regexp_extract(text, r"^(\d{14})\s+(\S+)", 1), F.regexp_extract(text, r"^(\d{14})\s+(\S+)", 2)
    kind = F.when(F.lower(url).endswith(".pdf"), "pdf").when(url.rlike(r"/score/\d+"), "score").otherwise("page")
    return lines.select(ts.alias("ts"), url.alias("url"), kind.alias("kind")).where("ts <> ''")


_COLLECTORS: dict[str, Callable[..., DataFrame]] = {}


def collector(name: str):
    """Registers a source under a name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _COLLECTORS[name] = f
        return f

    return register


def collect_all(spark: SparkSession, *args, only: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all sources with a kind column, and the error of each that failed; one failure stops none."""
    out, errors = None, {}
    for name, f in sorted(_COLLECTORS.items()):
        if only is not None and name not in only:
            continue
        try:
            df = f(spark, *args).withColumn("kind", F.lit(name))
            df.schema  # noqa: B018 - analysed here, so that a broken source is caught here
        except Exception as e:  # noqa: BLE001 - reported, by design
            errors[name] = f"{type(e).__name__}: {e}"[:300]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, errors


def merge_inventory(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows stay; new ones only where the key is new (one per key)."""
    return known.unionByName(new.join(known.select(key), key, "left_anti").dropDuplicates([key]).select(known.columns))
