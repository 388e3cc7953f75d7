"""Raw topics of several domains in one stream, to normalised tables by domain and a quarantine.

A message is an envelope {"version", "source", "payload"} in a topic ``raw_<type>``. A domain has one canonical schema, checks, and
versions: the payload's schema in that version, and how its fields become the canonical columns. Fields that a version lacks are
null, fields that it has besides are listed in ``unknown_fields``, and old and new versions arrive side by side, in any order.

Every message ends in exactly one place: ``normalized_<type>``, with its envelope (source, version, ingest_ts, payload_hash), or
``quarantine``, with the raw text and the first reason that holds. Both are written by micro-batch number, so a batch that is run
again after a failure replaces what it had written. A row's domain decides its columns, so the parsing of all versions is one
projection over the stream, in which a message is parsed once, by its own version's schema. The number of projections does not depend
on that of domains and versions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Version:
    """``fields``: the payload's schema (DDL). ``columns``: canonical column to SQL over ``p``, the payload; of the same name if not given."""

    fields: str
    columns: dict[str, str]


@dataclass(frozen=True)
class Domain:
    """``columns``: the canonical schema (DDL). ``checks``: (SQL that bad rows meet, the reason), the first counts."""

    columns: str
    checks: tuple[tuple[str, str], ...]
    versions: dict[str, Version]


# The reasons of quarantine that quotes have elsewhere too.
_PRICE, _SYMBOL = "Price must be positive", "Symbol cannot be empty"
REGISTRY: dict[str, Domain] = {
    "quotes": Domain(
        "symbol string, ts timestamp, seq bigint, price double, volume bigint, bid double, ask double",
        (("symbol is null or ts is null or price is null", "Message does not fit the schema"), ("symbol = ''", _SYMBOL), ("price <= 0", _PRICE), ("bid > ask", "Bid is above ask")),
        {
            "1": Version("symbol string, ts string, seq bigint, price double, volume bigint", {"ts": "to_timestamp(p.ts)"}),
            "2": Version("symbol string, at_ms bigint, seq bigint, last double, volume bigint, bid double, ask double", {"ts": "timestamp_millis(p.at_ms)", "price": "p.last"}),
            "3": Version("instrument struct<symbol: string, exchange: string>, at_ms bigint, seq bigint, last double, size bigint, bid double, ask double", {"symbol": "p.instrument.symbol", "ts": "timestamp_millis(p.at_ms)", "price": "p.last", "volume": "p.size"}),
        },
    ),
    "news": Domain(
        "id bigint, published timestamp, language string, origin string, body string",
        (("id is null", "Message does not fit the schema"), ("coalesce(trim(body), '') = ''", "Text is empty")),
        {
            "1": Version("id bigint, text string, lang string", {"body": "p.text", "language": "p.lang"}),
            "2": Version("id bigint, body string, language string, origin string", {}),
        },
    ),
    "announcements": Domain(
        "id bigint, symbol string, published timestamp, title string, body string",
        (("id is null", "Message does not fit the schema"), ("coalesce(symbol, '') = ''", _SYMBOL), ("coalesce(trim(title), '') = ''", "Title is empty")),
        {"1": Version("id bigint, symbol string, published string, title string, body string", {"published": "to_timestamp(p.published)"})},
    ),
    "financials": Domain(
        "symbol string, period string, item string, amount double",
        (("symbol is null or period is null or item is null", "Message does not fit the schema"), ("symbol = ''", _SYMBOL), ("amount is null or isnan(amount)", "Amount is missing")),
        {
            "1": Version("symbol string, period string, item string, amount double", {}),
            "2": Version("symbol string, year int, quarter int, item string, thousands double", {"period": "concat(p.year, 'Q', p.quarter)", "amount": "p.thousands * 1000"}),
        },
    ),
    "fundflow": Domain(
        "symbol string, day date, inflow double, outflow double",
        (("symbol is null or day is null", "Message does not fit the schema"), ("symbol = ''", _SYMBOL), ("inflow < 0 or outflow < 0", "Flow is negative")),
        {
            "1": Version("symbol string, day string, net double", {"day": "to_date(p.day)", "inflow": "greatest(p.net, 0d)", "outflow": "greatest(-p.net, 0d)"}),
            "2": Version("symbol string, day string, inflow double, outflow double", {"day": "to_date(p.day)"}),
        },
    ),
}


def raw_topics(spark: SparkSession, path: str | None = None, servers: str | None = None, registry: dict[str, Domain] = REGISTRY) -> DataFrame:
    """(type, value) of all raw topics in one stream: Kafka, or folders ``raw_<type>`` of text files with a message in a line.

    A folder of a type without a domain is read too, and its messages are quarantined.
    """
    if servers:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", "raw_.*").load()
        return raw.select(F.regexp_extract("topic", "^raw_(.*)$", 1).alias("type"), F.col("value").cast("string").alias("value"))
    raw = spark.readStream.text(f"{path}/raw_*")
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"/raw_([^/]*)/[^/]*$", 1).alias("type"), "value")


_ENVELOPE = "version string, source string, payload string"


def _payload(version: Version) -> T.StructType:
    """With a field that tells a text that is no such JSON from one without values."""
    return T.StructType([*T._parse_datatype_string(version.fields).fields, T.StructField("_broken", T.StringType())])


def _canonical(domain: Domain, version: Version, p: str) -> Column:
    """The payload in column ``p`` as the domain's struct."""
    names = T._parse_datatype_string(version.fields).names
    columns = []
    for f in T._parse_datatype_string(domain.columns).fields:
        said = version.columns.get(f.name, f"p.{f.name}" if f.name in names else "null")
        columns.append(F.expr(f"cast({_of(said, p)} as {f.dataType.simpleString()})").alias(f.name))
    return F.struct(*columns)


def _of(said: str, p: str) -> str:
    """SQL over ``p`` as SQL over the column of that name."""
    return re.sub(r"'[^']*'|\bp\.", lambda m: f"{p}." if m[0] == "p." else m[0], said)


def normalised(messages: DataFrame, registry: dict[str, Domain] = REGISTRY, now: Column | None = None) -> DataFrame:
    """(type, value) to type, value, version, source, ingest_ts, payload_hash, unknown_fields, reason, and a struct for each domain.

    ``reason`` is null for sound messages; a domain's struct is null in messages of others.
    """
    said = messages.select("type", "value", F.from_json("value", _ENVELOPE).alias("e"))
    rows = said.select("type", "value", "e.version", "e.source", "e.payload", F.current_timestamp().alias("ingest_ts") if now is None else now.alias("ingest_ts"), F.sha2(F.coalesce("e.payload", "value"), 256).alias("payload_hash"))
    versions = [(name, number, domain, version) for name, domain in registry.items() for number, version in domain.versions.items()]
    mine = {(name, number): (F.col("type") == name) & (F.col("version") == number) for name, number, _, _ in versions}
    parsed = {f"p_{name}_{number}": F.when(mine[name, number], F.from_json("payload", _payload(version), {"columnNameOfCorruptRecord": "_broken"})) for name, number, _, version in versions}
    rows = rows.withColumns(parsed)  # all versions in one step, so that a message is copied once and not by each version
    reason = F.when(~F.col("type").isin(*registry), "Unknown topic").when(F.col("payload").isNull(), "Message is no envelope")
    versioned, known = F.lit(False), F.lit(None).cast("array<string>")
    made = {}
    for name in registry:
        struct, broken = F.lit(None), F.lit(False)
        for _, number, domain, version in (v for v in versions if v[0] == name):
            own, p = mine[name, number], f"p_{name}_{number}"
            struct = F.when(own, _canonical(domain, version, p)).otherwise(struct)
            broken = F.when(own, F.col(p).isNull() | F.col(f"{p}._broken").isNotNull()).otherwise(broken)
            known = F.when(own, F.array(*[F.lit(f) for f in T._parse_datatype_string(version.fields).names])).otherwise(known)
            versioned = versioned | own
        made |= {name: struct, f"b_{name}": broken}
    unknown = F.when(versioned, F.array_except(F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")), known))
    rows = rows.withColumns(made)
    rows = rows.withColumn("unknown_fields", unknown)
    reason = reason.when(~F.coalesce(versioned, F.lit(False)), "Unknown version")
    for name, domain in registry.items():
        reason = reason.when(F.col(f"b_{name}"), "Message does not fit the schema")
    first = F.lit(None).cast("string")
    for name, domain in registry.items():
        checks = F.lit(None).cast("string")
        names = T._parse_datatype_string(domain.columns).names
        for bad, why in reversed(domain.checks):
            checks = F.when(F.coalesce(_over(bad, name, names), F.lit(False)), why).otherwise(checks)
        first = F.when(F.col("type") == name, checks).otherwise(first)
    rows = rows.withColumn("reason", reason.otherwise(first))
    return rows.select("type", "value", "version", "source", "ingest_ts", "payload_hash", "unknown_fields", "reason", *registry)


def _over(condition: str, struct: str, names: list[str]) -> Column:
    """A condition over canonical columns, as one over the domain's struct."""
    return F.expr(re.sub(r"'[^']*'|\b(" + "|".join(names) + r")\b", lambda m: f"{struct}.{m[1]}" if m[1] else m[0], condition))


def ingest(messages: DataFrame, out: str, checkpoint: str, registry: dict[str, Domain] = REGISTRY, now: Column | None = None) -> None:
    """Run the topics to their end, into ``<out>/normalized_<type>/batch=<n>`` and ``<out>/quarantine/batch=<n>``."""

    def sink(batch: DataFrame, number: int) -> None:
        # The checks of all domains make a method too long for HotSpot to compile (8,000 bytes), so Spark shall split it; the session is the stream's own.
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
        rows = normalised(batch, registry, now).persist()
        envelope = ["source", "version", "ingest_ts", "payload_hash", "unknown_fields"]
        for name in registry:
            good = rows.filter((F.col("type") == name) & F.col("reason").isNull()).select(f"{name}.*", *envelope)
            good.write.mode("overwrite").parquet(f"{out}/normalized_{name}/batch={number}")
        rows.filter("reason is not null").select("type", "version", "value", "reason", "ingest_ts").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        rows.unpersist()

    messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def normalized_table(spark: SparkSession, out: str, name: str, registry: dict[str, Domain] = REGISTRY) -> DataFrame:
    schema = registry[name].columns + ", source string, version string, ingest_ts timestamp, payload_hash string, unknown_fields array<string>, batch bigint"
    return spark.read.schema(schema).parquet(f"{out}/normalized_{name}")


def quarantine_table(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("type string, version string, value string, reason string, ingest_ts timestamp, batch bigint").parquet(f"{out}/quarantine")
