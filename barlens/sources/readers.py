"""Scans: bars, receipts, provider pages, snapshots, partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.scalar import reasons
from barlens.schema import BAR_COLUMNS, require_columns


#: The upper-cased symbol of a corpus that is scanned by symbol.
KEY = "symbol_key"


def scan_bars(spark: SparkSession, *paths: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Bars of any number of Parquet files or folders, canonical columns that exist.

    Symbols match in any spelling. Corpora of :func:`barlens.sources.writers.write_bars`
    keep the upper-cased symbol: its values reach the scan, which skips files'
    row groups by their statistics and Bloom filters. Elsewhere two ranges for
    each first letter, one a case, are stated on the column as stored.
    """
    df = spark.read.parquet(*paths)
    out = df
    if symbols is not None:
        wanted = sorted({s.upper() for s in symbols})
        if KEY in df.columns:
            out = out.where(F.col(KEY).isin(*wanted))
        else:
            first = sorted({c for s in wanted for c in (s[:1], s[:1].lower())})
            if all(c and c.isascii() for c in first):
                spans = F.lit(False)
                for c in first:
                    spans = spans | ((F.col("symbol") >= c) & (F.col("symbol") < chr(ord(c) + 1)))
                out = out.where(spans)
            out = out.where(F.upper("symbol").isin(*wanted))
    return out.select(*(c for c in BAR_COLUMNS if c in df.columns))


def symbols_of(df: DataFrame) -> DataFrame:
    """Distinct upper-case symbols; only the symbol column is read."""
    return df.select(F.upper("symbol").alias("symbol")).distinct()


def read_any(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Parquet or CSV by suffix, with the required columns present."""
    is_csv = path.rstrip("/").lower().endswith(".csv")
    df = spark.read.csv(path, header=True) if is_csv else spark.read.parquet(path)
    return require_columns(df, required)


SNAPSHOT_COLUMNS = ("instrument_id", "symbol", "security_type", "effective_date", "source")


def check_snapshot(snapshot: DataFrame, effective: str) -> DataFrame:
    """Violations of a constituent snapshot, one count per rule."""
    blank = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)) == 0
    d = F.col("effective_date").try_cast("date")
    per = snapshot.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((d.isNull() | (d != F.lit(effective).cast("date"))).cast("int")).alias("date"),
        F.sum(blank("source").cast("int")).alias("source"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        zero("n").alias("rows"),
        zero("date").alias("wrong_effective_date"),
        zero(F.when(blank("instrument_id"), F.col("n")).otherwise(0)).alias("empty_identity"),
        zero(F.col("n") - 1).alias("duplicate_identity"),
        zero("source").alias("missing_source"),
    )


def read_receipts(
    spark: SparkSession, receipts: str, responses: str, known: DataFrame, *, feed: str = "sip", adjustment: str = "raw",
    identity: Column | None = None,
) -> DataFrame:
    """Receipts with the verdict on their response file.

    ``identity`` derives the chunk from the response ``path`` (file stem by default).

    Responses are hashed where they are read; only digests and lengths travel
    to the join. A response is one chunk (one instrument and month), so a file
    fits a task.
    """
    r = spark.read.schema(
        "chunk_identity string, instrument_id string, symbol string, status string, feed string, adjustment string, "
        "response_sha256 string, row_count long"
    ).json(receipts)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(responses)
    if identity is None:
        identity = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.response$", "")
    digests = files.select(
        identity.alias("chunk_identity"),
        F.sha2("content", 256).alias("_sha"),
        F.col("length").alias("bytes"),
    )
    ids = known.select("instrument_id").distinct().withColumn("_known", F.lit(True))
    j = r.join(digests, "chunk_identity", "left").join(ids, "instrument_id", "left")
    done = F.col("status") == "complete"
    return j.withColumn(
        "verdict",
        F.when(~done, "not_complete")
        .when(F.col("_known").isNull(), "unknown_instrument")
        .when(F.col("_sha").isNull(), "missing_response")
        .when(F.col("_sha") != F.col("response_sha256"), "hash_mismatch")
        .when((F.col("feed") != feed) | (F.col("adjustment") != adjustment), "wrong_feed_or_adjustment")
        .otherwise("verified"),
    ).drop("_sha", "_known")


def load_partition(spark: SparkSession, root: str, instrument_id: str) -> DataFrame:
    """One instrument of a Hive-partitioned corpus through partition pruning."""
    return spark.read.parquet(root).where(F.col("instrument_id") == instrument_id)


PAGE = "bars map<string, array<struct<t:string,o:double,h:double,l:double,c:double,v:bigint,n:bigint,vw:double>>>"


def provider_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Provider pages, a row each: a file holds one, the answer to one request (a symbol and a month)."""
    return spark.read.text(list(paths), wholetext=True)


def flatten_provider_json(pages: DataFrame, identities: DataFrame, column: str = "value", *, strict: bool = False) -> DataFrame:
    """Bar rows of provider pages, with a status for unknown symbols and repeats; ``strict`` makes these errors.

    ``identities``: ``symbol, instrument_id``. A row is never larger than a page.
    """
    page = F.from_json(F.col(column), PAGE)["bars"]
    rows = pages.select(F.explode(page).alias("symbol", "_obs")).select(
        F.upper("symbol").alias("symbol"), F.inline("_obs")
    )
    ids = identities.select(F.upper("symbol").alias("symbol"), "instrument_id")
    bars = rows.join(ids, "symbol", "left").select(
        "instrument_id",
        "symbol",
        F.try_to_timestamp("t").alias("ts"),
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"),
        F.col("v").alias("volume"), F.col("n").alias("trade_count"), F.col("vw").alias("vwap"),
    )
    keys = bars.groupBy("instrument_id", F.to_date("ts").alias("_d")).agg(F.count(F.lit(1)).alias("_copies"))
    flat = (
        bars.withColumn("_d", F.to_date("ts"))
        .join(keys, ["instrument_id", "_d"], "left")
        .withColumn(
            "violations",
            reasons(
                (F.col("instrument_id").isNull(), "unknown_symbol"),
                (F.col("ts").isNull(), "timestamp"),
                (F.col("_copies") > 1, "duplicate_day"),
            ),
        )
        .drop("_d", "_copies")
    )
    if not strict:
        return flat
    told = F.concat(F.lit("provider page: "), F.array_join("violations", ","), F.lit(" for "), F.col("symbol"), F.lit(" at "), F.coalesce(F.col("ts").cast("string"), F.lit("no time")))
    return flat.where(F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


# Volume and price shapes of the synthetic scenarios, in the session position p.
def volume_shape(name: str, p: Column) -> Column:
    shapes = {
        "uniform": F.lit(1.0) + p * 0,
        "u": 0.55 + 2.2 * F.pow(2 * p - 1, F.lit(2.0)),
        "front": 0.4 + 2 * F.pow(1 - p, F.lit(2.0)),
        "back": 0.4 + 2 * F.pow(p, F.lit(2.0)),
        "low": F.lit(0.15) + p * 0,
        "drought": 1 - 0.85 * F.exp(-F.pow((p - 0.5) / 0.14, F.lit(2.0))),
        "opening": 0.65 + 4 * F.exp(-p / 0.06),
        "closing": 0.65 + 4 * F.exp(-(1 - p) / 0.06),
    }
    return shapes[name]


def price_path(name: str, p: Column, base: Column, rate: float) -> Column:
    """Constant, adverse (rising) or favourable (falling) trend."""
    direction = {"constant": 0.0, "adverse": 1.0, "favorable": -1.0}[name]
    return base * F.exp(F.lit(direction * rate) * p)


def scenario_bars(
    sessions: DataFrame, *, buckets: int, volume: str = "u", price: str = "constant", rate: float = 0.01,
    base_price: str = "base_price", base_volume: str = "base_volume", noise: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Synthetic bars for every row of ``sessions``, generated where the row lives."""
    i = F.col("bucket")
    p = (i + 0.5) / F.lit(float(buckets))
    grid = sessions.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    v = F.col(base_volume) * volume_shape(volume, p)
    px = price_path(price, p, F.col(base_price), rate)
    if noise > 0:
        v = v * F.exp(F.randn(seed) * noise)
    vol = F.greatest(F.bround(v, 0), F.lit(0.0)).cast("bigint")
    return grid.withColumns(
        {
            "open": px, "high": px * 1.0005, "low": px * 0.9995, "close": px, "vwap": px,
            "volume": vol,
            "trade_count": F.greatest(F.lit(1), F.ceil(vol / 100)),
            "scenario_volume": F.lit(volume), "scenario_price": F.lit(price), "scenario_seed": F.lit(seed),
        }
    )
