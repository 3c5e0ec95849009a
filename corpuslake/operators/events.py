"""Usage events: identities, pseudonyms, rollups and alerts (AGG-11..13, 17, 18, FN-26..30, STR-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.scalars import caller_ip


def actor_class(api_key: Column, service: Column, break_glass: Column, user: Column, token: Column) -> Column:
    """The strongest identity of a request."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(api_key), "api-key").when(yes(service), "service").when(yes(break_glass), "break-glass")
        .when(yes(user), "user").when(yes(token), "unknown").otherwise("anonymous")
    )


def device_class(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)mobile|android|iphone"), "mobile").otherwise("desktop")


def _hmac_pads(key: Column) -> tuple[Column, Column]:
    """The key's outer and inner block of a keyed digest."""
    short = F.when(F.length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    block = F.rpad(F.hex(short), 128, "0")

    def pad(with_: int) -> Column:
        byte = lambda i: F.conv(F.substr(block, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(with_))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))

    return F.when(key.isNotNull(), pad(0x5C)), F.when(key.isNotNull(), pad(0x36))


def _hmac_of(outer: Column, inner: Column, message: Column) -> Column:
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """Hex digits of the keyed digest of bytes, composed of built-in functions; null where either is."""
    return _hmac_of(*_hmac_pads(key), message)


def with_pseudonyms(events: DataFrame, salts: DataFrame, who: str = "user_id", ts: str = "ts") -> DataFrame:
    """``events`` with ``pseudonym``: 32 hex digits of the keyed digest of ``who`` under the salt in force.

    ``salts`` are (since, salt as bytes). A salt holds from its time to the next one, and not beyond its day: so no pseudonym outlives
    a day, and a salt made anew within a day starts new ones. Without a salt in force it is null. Both sides meet by day, and salts are few a day:
    they are broadcast with the blocks of their keyed digests, which are made once a salt.
    """
    next_ = F.lead("since").over(Window.partitionBy("day").orderBy("since"))
    own = salts.select(F.to_date("since").alias("day"), "since", "salt").withColumn("until", next_)
    outer, inner = _hmac_pads(F.col("salt"))
    own = own.select(F.col("day").alias("__day"), F.col("since").alias("__since"), F.col("until").alias("__until"), outer.alias("__outer"), inner.alias("__inner"))
    at = F.col(ts)
    holds = (F.to_date(at) == F.col("__day")) & (at >= F.col("__since")) & (F.col("__until").isNull() | (at < F.col("__until")))
    digest = F.substring(_hmac_of(F.col("__outer"), F.col("__inner"), F.col(who).cast("string").cast("binary")), 1, 32)
    return events.join(F.broadcast(own), holds, "left").withColumn("pseudonym", digest).drop("__day", "__since", "__until", "__outer", "__inner")


def request_rows(requests: DataFrame) -> DataFrame:
    """Finished requests (method, url, status, duration_ms, bytes, forwarded, remote, user, key_id, client) as structured rows with their line and level.

    The path has no query string, so that requests of one route stay together; percent signs are escaped in the line, which a logger would take for places of arguments.
    """
    ip = caller_ip(F.col("forwarded"), F.col("remote"))
    principal = F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit("anonymous"))
    credential = F.coalesce(F.concat(F.lit(" key="), F.nullif(F.col("key_id"), F.lit(""))), F.concat(F.lit(" client="), F.nullif(F.col("client"), F.lit(""))), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(text("method"), F.lit(" "), text("url"), F.lit(" "), text("status"), F.lit(" - "), text("bytes"), F.lit(" B - "), text("duration_ms"), F.lit("ms (IP: "), F.coalesce(ip, F.lit("-")), F.lit(", as: "), principal, credential, F.lit(")"))
    level = F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warn").otherwise("info")
    return requests.select(
        F.lit("request").alias("evt"), "method", F.substring_index("url", "?", 1).alias("path"), "status", F.col("duration_ms").cast("double").alias("duration_ms"), F.col("bytes").cast("long").alias("bytes"),
        ip.alias("ip"), principal.alias("principal"), F.nullif(F.col("key_id"), F.lit("")).alias("key_id"), F.nullif(F.col("client"), F.lit("")).alias("client"), level.alias("level"), F.replace(line, F.lit("%"), F.lit("%25")).alias("message"),
    )


def day_key(ts: Column) -> Column:
    return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")


def hourly_rollup(events: DataFrame, by: list[str], exact: bool = True, ts: str = "ts", who: str = "user_id", value: str = "value") -> DataFrame:
    """Count, distinct users and mean value by hour."""
    users = F.countDistinct(who) if exact else F.approx_count_distinct(who)
    rolled = events.groupBy(F.window(ts, "1 hour").alias("w"), *by).agg(F.count("*").alias("events"), users.alias("users"), F.round(F.avg(value), 6).alias("mean_value"))
    return rolled.select(F.col("w.start").alias("hour"), *by, "events", "users", "mean_value")


def quota_alert(events: DataFrame, quota: float, share: float = 0.8, ts: str = "ts", value: str = "value", width: str = "1 day", step: str = "1 hour") -> DataFrame:
    """Sliding windows whose sum is over a share of the quota. Hours are summed first, so that a row is
    repeated for its 24 windows only after it was added to its hour."""
    hours = events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.sum(value).alias("used"))
    wide = hours.groupBy(F.window("hour", width, step).alias("w")).agg(F.round(F.sum("used"), 4).alias("used"))
    return wide.filter(F.col("used") > quota * share).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "used")


def log_alert(events: DataFrame, matches: Column, ts: str = "ts", width: str = "15 minutes") -> DataFrame:
    return events.filter(matches).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def rate_limited(requests: DataFrame, caller: str, limit: int = 300, ts: str = "ts", width: str = "60 seconds") -> DataFrame:
    """Callers and windows over the limit."""
    counted = requests.groupBy(F.window(ts, width).alias("w"), caller).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select(F.col("w.start").alias("start"), caller, "n")


def cost(prompt: Column, completion: Column, prompt_rate: float, completion_rate: float) -> Column:
    """Cost by tokens at rates for a million; null where usage is not known."""
    return (prompt * prompt_rate + completion * completion_rate) / 1e6


#: What a usage row may keep in a log.
_USAGE = ("time_generated", "event_name", "project_id", "env")


def redact(rows: DataFrame, stream: str) -> DataFrame:
    """What may be logged of rows that could not be delivered: an audit row without its address, as the record must not be lost; of a usage row nothing that tells who or what was searched."""
    return rows.drop("source_ip") if stream == "audit" else rows.select(*(c for c in rows.columns if c in _USAGE))
