"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.spikes import CONVERSATIONS, DOCUMENTS, NUMBERS, PAGES
from inkveil.functions import patterns
from inkveil.functions.cards import digits_of, issuer, passes_luhn
from inkveil.functions.detect import detections_sql
from inkveil.functions.detectors import entropy_detector, register_detector
from inkveil.functions.entropy import rejection, shannon_entropy
from inkveil.functions.numbers import IBAN, IPV6
from inkveil.operators import gate, intercept, report, summary
from inkveil.operators.allow import Scope, allowed_values, not_allowed
from inkveil.operators.redact import redacted
from inkveil.operators.totals import weekly_totals
from inkveil.operators.scan import findings, order_findings, overlaps, scan, with_scheme
from inkveil.plans.policy import ScanPolicy
from inkveil.session import keyed_state, shared_folder
from inkveil.sources import sinks
from inkveil.sources.audit import AuditLog
from inkveil.sources.feed import TEXTS, read_feed
from inkveil.sources.files import judge_listed, read_texts, unreadable
from inkveil.sources.tables import read_table
from inkveil.streaming.debounce import ON_TIME, last_of_bursts, last_of_bursts_stream, with_lateness
from inkveil.streaming.latch import BlockLatch
from inkveil.streaming.latest import LatestFindings, latest_per_key
from inkveil.streaming.scan import stream_table, write_stream

Query = Callable[[SparkSession, str], DataFrame]

TWO_HOURS_MS = 2 * 60 * 60 * 1000


# --- inputs -----------------------------------------------------------------
def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return raw_documents(spark, sf).select("doc_id", F.expr(DOCUMENTS).alias("text"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "pages")
    return table.select("page_id", "url", F.expr(PAGES).alias("text"))


def with_spikes(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", F.expr(CONVERSATIONS).alias("text"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return with_spikes(read_table(spark, sf, "conversations"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


def only_detector(name: str) -> ScanPolicy:
    return ScanPolicy.batch([name])


# --- detectors --------------------------------------------------------------
def one_detector(name: str, source: Query = documents) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return findings(source(spark, sf), ["doc_id"], "text", only_detector(name))

    return query


def matches(df: DataFrame, pattern: str) -> DataFrame:
    """All matches of a pattern, checked or not: position in the list and value."""
    return df.select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    ).toDF("doc_id", "nth", "value")


def q_luhn(spark: SparkSession, sf: str) -> DataFrame:
    return matches(documents(spark, sf), patterns.CARD).select(
        "doc_id",
        (F.col("nth") + 1).alias("nth"),
        digits_of("value").alias("digits"),
        passes_luhn("value").alias("valid"),
    )


def q_card_prefix(spark: SparkSession, sf: str) -> DataFrame:
    found = matches(documents(spark, sf), patterns.CARD)
    return found.groupBy(
        F.coalesce(issuer("value"), F.lit("none")).alias("issuer"),
        passes_luhn("value").alias("luhn"),
    ).agg(F.count(F.lit(1)).alias("n"))


def q_shannon(spark: SparkSession, sf: str) -> DataFrame:
    return raw_documents(spark, sf).select(
        "doc_id", F.round(shannon_entropy("text"), 9).alias("bits")
    )


def q_entropy_filters(spark: SparkSession, sf: str) -> DataFrame:
    found = matches(documents(spark, sf), patterns.TOKEN_RUN)
    return found.groupBy(F.coalesce(rejection("value"), F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(shannon_entropy("value") > 4.5).alias("n_above"),
    )


def q_entropy_low_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = F.expr(detections_sql("text", [(0, entropy_detector(3.5))]))
    return (
        documents(spark, sf)
        .select("doc_id", F.explode_outer(found).alias("d"))
        .where(F.col("d").isNotNull())
        .select("doc_id", "d.start", "d.end", "d.value")
        .select("doc_id", "start", "end", shannon_entropy("value").alias("bits"))
    )


# --- scan -------------------------------------------------------------------
def q_scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return findings(documents(spark, sf), ["doc_id"])


def q_scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return findings(pages(spark, sf), ["page_id"])


def q_scan_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return findings(conversations(spark, sf), ["conv_id", "turn"])


def q_scan_nested(spark: SparkSession, sf: str) -> DataFrame:
    span = F.transform(
        "detections",
        lambda d: F.concat(
            d["type"], F.lit("@"), d["start"].cast("string"), F.lit("-"), d["end"].cast("string")
        ),
    )
    return scan(documents(spark, sf)).select(
        "doc_id",
        "text_length",
        F.size("detections").alias("n_findings"),
        F.array_join(span, ",").alias("spans"),
    )


def q_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in code points and UTF-16 units, from two scans of the same row."""
    base = documents(spark, sf)
    both = scan(scan(base).withColumnRenamed("detections", "points"), utf16=True)
    zipped = F.explode_outer(F.arrays_zip("points", "detections")).alias("z")
    rows = both.select("doc_id", "text", zipped).where(F.col("z").isNotNull())
    points = F.col("z.points")
    value = F.substring(F.col("text"), points["start"] + 1, points["end"] - points["start"])
    return rows.select(
        "doc_id",
        points["type"].alias("type"),
        points["start"].alias("start"),
        points["end"].alias("end"),
        (value == points["value"]).alias("holds"),
        F.col("z.detections.start").alias("start_utf16"),
    )


def q_scan_only_email(spark: SparkSession, sf: str) -> DataFrame:
    policy = ScanPolicy.batch(["email", "no-such-detector"])
    return findings(documents(spark, sf), ["doc_id"], "text", policy)


def min_severity(level: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        policy = ScanPolicy.batch(min_severity=level)
        return findings(documents(spark, sf), ["doc_id"], "text", policy)

    return query


def q_ordered_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings are written before they are sorted: a range sort reads its input twice."""
    nested = scan(documents(spark, sf))
    flat = nested.select("doc_id", F.posexplode_outer("detections").alias("pos", "d"))
    flat = flat.where(F.col("pos").isNotNull()).select("doc_id", "pos", "d.*")
    place = f"{_workspace(spark)}/found"
    flat.drop("value").write.parquet(place)
    ordered = order_findings(spark.read.schema(flat.drop("value").schema).parquet(place), ["doc_id"])
    return ordered.select("doc_id", (F.col("pos") + 1).alias("nth"), "type", "start")


def q_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(documents(spark, sf), ["doc_id"])


def q_detector_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return summary.catalog_coverage(documents(spark, sf))


def q_scheme_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = with_scheme(pages(spark, sf), "url", ("file", "untitled", "https"))
    return findings(wanted, ["page_id"])


def q_custom_detector(spark: SparkSession, sf: str) -> DataFrame:
    word = register_detector(
        "capital-tion",
        r"(?<!\w)[A-Z][a-z]+tion(?!\w)",
        category="pii",
        severity="low",
        message="word",
        literals=["tion"],
        accept="length(value) % 2 = 0",
    )
    policy = ScanPolicy(enabled=(), extra=(word,))
    found = findings(raw_documents(spark, sf), ["doc_id"], "text", policy)
    return found.select("doc_id", "type", "severity", "value")


def of_numbers(detector) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        texts = raw_documents(spark, sf).select("doc_id", F.expr(NUMBERS).alias("text"))
        found = findings(texts, ["doc_id"], "text", ScanPolicy(enabled=(), extra=(detector,)))
        return found.groupBy("doc_id", "type", "severity", "value").agg(F.count(F.lit(1)).alias("n"))

    return query


def q_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Findings that no entry allows: values found in some documents, partly limited to a
    detector or a path, and a scope without values."""
    texts = documents(spark, sf).withColumn(
        "path", F.concat(F.lit("docs/"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), F.col("doc_id"))
    )
    place = f"{_workspace(spark)}/found"
    findings(texts, ["doc_id", "path"]).write.parquet(place)
    found = spark.read.parquet(place)  # searched once, for the list and for what is left
    listed = found.where(F.col("doc_id") % 3 == 0).select(
        "value",
        F.when(F.col("doc_id") % 2 == 0, F.col("type")).alias("type"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("docs/1")).alias("path"),
    )
    scopes = [Scope(type="ssn", path="docs/2/"), Scope(path="docs/3")]
    rest = not_allowed(found, allowed_values(listed, "secret"), "secret", "path", scopes)
    return rest.select("doc_id", "type", "start", "value")


# --- redaction --------------------------------------------------------------
def q_redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(documents(spark, sf)).drop("text")


def q_redact_exact(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(documents(spark, sf), mode="exact").drop("text")


def q_redact_only_pii(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(documents(spark, sf), categories=["pii"]).drop("text")


def q_redacted_corpus(spark: SparkSession, sf: str) -> DataFrame:
    clean = redacted(pages(spark, sf), out="html")
    return clean.select("page_id", "html", (F.col("n_redacted") > 0).alias("changed"))


# --- reports and gates ------------------------------------------------------
def q_finding_lines(spark: SparkSession, sf: str) -> DataFrame:
    return findings(documents(spark, sf), ["doc_id"], lines=True).select(
        "doc_id", "type", "start", "line", "col"
    )


def q_caret_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.marked_lines(documents(spark, sf), ["doc_id"], F.col("doc_id")).select(
        "doc_id", "type", "start", "line", "col", "marks", "entry"
    )


def q_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return report.headlines(documents(spark, sf), ["doc_id"], F.col("doc_id")).select(
        "doc_id", "headline"
    )


def q_json_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.json_report(documents(spark, sf), ["doc_id"], F.col("doc_id"))


def q_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return gate.verdicts(documents(spark, sf)).select("doc_id", "verdict")


def q_verdicts_hook(spark: SparkSession, sf: str) -> DataFrame:
    return gate.verdicts(documents(spark, sf), hook=True).select("doc_id", "verdict")


def q_gate_critical(spark: SparkSession, sf: str) -> DataFrame:
    policy = ScanPolicy.batch(min_severity="critical")
    return gate.verdicts(documents(spark, sf), "text", policy, hook=True).select(
        "doc_id", "verdict"
    )


def q_corpus_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.run_verdict(gate.verdicts(documents(spark, sf)))


def q_unreadable_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as the sources asked for, documents as the texts that could be read."""
    asked = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("source")).distinct()
    texts = documents(spark, sf).withColumnRenamed("doc_id", "source")
    judged = judge_listed(asked, gate.verdicts(texts))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# --- interception -----------------------------------------------------------
def q_intercept_warn(spark: SparkSession, sf: str) -> DataFrame:
    return intercept.warn(conversations(spark, sf))


def q_intercept_redact(spark: SparkSession, sf: str) -> DataFrame:
    return intercept.redact_messages(conversations(spark, sf))


def q_intercept_block(spark: SparkSession, sf: str) -> DataFrame:
    return intercept.blocked(conversations(spark, sf))


def q_forwarded_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return intercept.not_blocked(conversations(spark, sf))


def q_forward_roles(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "conversations")
    messages = table.withColumn("parts", F.array("text", F.lit(None), "role")).withColumn(
        "text", intercept.join_text_parts("parts")
    )
    return intercept.forward(messages.drop("parts")).select("conv_id", "turn", "role", "text")


def q_prompt_check(spark: SparkSession, sf: str) -> DataFrame:
    prompts = conversations(spark, sf).where(F.col("role") == "user")
    return intercept.check_prompts(prompts, ["conv_id", "turn"])


def q_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return intercept.conversation_tokens(read_table(spark, sf, "conversations"))


def with_emoji(sf_table: DataFrame, key: str) -> DataFrame:
    """Characters outside the basic plane in front of every third text."""
    prefix = F.when(F.col(key) % 3 == 0, F.lit("\U0001f600\U0001f680 ")).otherwise("")
    return sf_table.withColumn("text", F.concat(prefix, "text"))


def q_token_estimate_utf16(spark: SparkSession, sf: str) -> DataFrame:
    table = with_emoji(read_table(spark, sf, "conversations"), "conv_id")
    return intercept.conversation_tokens(table, utf16=True)


def q_json_report_utf16(spark: SparkSession, sf: str) -> DataFrame:
    texts = with_emoji(documents(spark, sf), "doc_id")
    return report.json_report(texts, ["doc_id"], F.col("doc_id"), utf16=True)


# --- summaries --------------------------------------------------------------
def q_count_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return summary.count_by_type(documents(spark, sf))


def q_first_seen_types(spark: SparkSession, sf: str) -> DataFrame:
    return summary.first_seen_types(documents(spark, sf), ["doc_id"])


def q_count_by_type_severity(spark: SparkSession, sf: str) -> DataFrame:
    return summary.count_by_type_severity(documents(spark, sf))


def q_count_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return summary.count_per_row(documents(spark, sf), ["doc_id"])


def q_display_levels(spark: SparkSession, sf: str) -> DataFrame:
    return summary.count_by_level(documents(spark, sf))


def q_weekly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the week and the user of the event of the same number, users in teams."""
    own = events(spark, sf).select(F.col("event_id").alias("doc_id"), "ts", "user_id")
    placed = documents(spark, sf).join(own, "doc_id", "left")
    placed = placed.withColumn("squad", F.col("user_id") % 7)
    return weekly_totals(placed, "ts", "user_id", "squad").withColumnRenamed("person", "member")


# --- streams ----------------------------------------------------------------
def q_debounce_events(spark: SparkSession, sf: str) -> DataFrame:
    last = last_of_bursts(events(spark, sf), "user_id", "ts", "event_id", TWO_HOURS_MS)
    return last.select("event_id", "user_id", "ts", "event_type")


def q_debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The session windows of the stream, here over the table in batch."""
    last = last_of_bursts_stream(
        events(spark, sf), "user_id", "ts", "event_id", TWO_HOURS_MS, delay="10 seconds"
    )
    return last.select("event_id", "user_id", "ts", "event_type")


def q_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    last = latest_per_key(
        events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error"
    )
    return last.select("user_id", "event_id", "ts", "event_type", "value")


def _workspace(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _conversation_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = read_table(spark, sf, "conversations").schema
    return with_spikes(stream_table(spark, sf, "conversations", schema))


def q_stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    place = _workspace(spark)
    found = findings(_conversation_stream(spark, sf), ["conv_id", "turn"])
    write_stream(found, f"{place}/out", f"{place}/state", available_now=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


def _run(stream: DataFrame, place: str, *partitions: str) -> DataFrame:
    """What a stream writes until its source is read to the end."""
    writer = stream.writeStream.format("parquet").trigger(availableNow=True)
    if partitions:
        writer = writer.partitionBy(*partitions)
    options = {"path": f"{place}/out", "checkpointLocation": f"{place}/state"}
    writer.options(**options).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


def q_debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events in three files, one a batch: every tenth event comes in the last one, late or not,
    and every fiftieth has no time.  What becomes of each event, none left out."""
    place = _workspace(spark)
    table = events(spark, sf).withColumns(
        {
            "ts": F.when(F.col("event_id") % 50 != 1, F.col("ts").cast("timestamp")),
            "part": F.when(F.col("event_id") % 10 == 0, 2).otherwise(F.col("event_id") % 2),
        }
    )
    # the end of all bursts: an event far behind the others
    end = table.groupBy().agg(F.max("ts").alias("last")).select(
        F.lit(-1).cast("long").alias("event_id"),
        (F.col("last") + F.expr("INTERVAL 999 DAYS")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"),
        F.lit("end").alias("event_type"),
        F.lit(0.0).alias("value"),
        F.lit(3).alias("part"),
    )
    table = table.select(*end.columns).unionByName(end)
    for part in range(4):
        rows = table.where(F.col("part") == part).drop("part")
        rows.coalesce(1).write.parquet(f"{place}/in/part={part}")
    read = spark.readStream.schema(table.drop("part").schema).option("maxFilesPerTrigger", 1)
    judged = with_lateness(
        read.option("recursiveFileLookup", True).parquet(f"{place}/in"), "ts", "36 hours"
    )
    written = _run(judged, f"{place}/judged", "lateness").where("event_id >= 0")
    on_time = spark.readStream.schema(judged.schema).parquet(f"{place}/judged/out")
    on_time = on_time.where(F.col("lateness") == ON_TIME).drop("lateness")
    bursts = last_of_bursts_stream(
        on_time, "user_id", "ts", "event_id", TWO_HOURS_MS, delay="36 hours"
    )
    last = _run(bursts.select("event_id"), f"{place}/bursts").withColumn("is_last", F.lit(True))
    return (
        written.select("event_id", "lateness")
        .join(last, "event_id", "left")
        .withColumn("is_last", F.coalesce("is_last", F.lit(False)))
    )


def q_block_latch(spark: SparkSession, sf: str) -> DataFrame:
    keyed_state(spark)
    return _run(BlockLatch().decided(_conversation_stream(spark, sf)), _workspace(spark))


def q_latest_findings(spark: SparkSession, sf: str) -> DataFrame:
    place = _workspace(spark)
    table = LatestFindings(["conv_id"], ["turn"], closed="role = 'user'")
    rows = table.rows(_conversation_stream(spark, sf))
    table.start(rows, f"{place}/out", f"{place}/state", available_now=True).awaitTermination()
    return table.read(spark, f"{place}/state").select(
        "conv_id", F.col("version.turn").alias("turn"), F.size("detections").alias("n_findings")
    )


def q_rescan_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A change of policy: findings of two detectors are kept, one is dropped, others are run."""
    place = _workspace(spark)
    texts = documents(spark, sf).withColumn("version", F.lit(1))
    before = ScanPolicy.documents(["email", "aws-access-key", "ssh-private-key"])
    rows = LatestFindings(["doc_id"], ["version"], policy=before).rows(texts)
    rows.write.parquet(f"{place}/before")
    table = LatestFindings(["doc_id"], ["version"], policy=before)
    after = ScanPolicy.documents().with_(min_severity="critical")
    again = table.rescan(spark.read.parquet(f"{place}/before"), texts, after)
    return again.select("doc_id", F.size("detections").alias("n_findings"))


def q_file_run(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as files, read by path and judged: some are empty, some not UTF-8, one
    that was asked for is not there."""
    place = _workspace(spark)
    texts = documents(spark, sf).select(
        F.concat("doc_id", F.lit(".txt")).alias("name"),
        F.when(F.col("doc_id") % 97 == 0, F.lit(b""))
        .when(F.col("doc_id") % 89 == 0, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
        .alias("content"),
    )
    sinks.write_texts(texts, "name", "content", f"{place}/files").write.parquet(f"{place}/written")
    files = read_texts(spark, [f"{place}/files", f"{place}/-1.txt"])
    judged = gate.verdicts(files, unreadable=unreadable())
    number = F.regexp_extract("source", "/(-?[0-9]+)[.]txt$", 1).cast("long")
    return judged.select(
        number.alias("doc_id"), (F.col("bytes") == 0).alias("is_empty"), "verdict"
    )


def q_feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Texts appended to a feed while a stream reads it; the stream stops and starts again."""
    place = _workspace(spark)
    texts = documents(spark, sf).select(F.concat_ws("\t", "doc_id", "text").alias("value"))
    policy = ScanPolicy.batch()
    for part, moduli in enumerate(((0, 1), (2,))):
        rows = texts.where((F.crc32("value") % 3).isin(*moduli))
        rows = rows.write.option("lineSep", "\0")
        rows.mode("append").text(f"{place}/feed/{part}")
        feed = read_feed(
            spark, f"{place}/feed", separator=TEXTS, batch_bytes=1 << 24, checkpoint=f"{place}/state"
        )
        # names that begin with an underscore are Spark's own
        own = feed.where("source NOT LIKE '%/_SUCCESS' AND source NOT LIKE '%.crc'")
        parts = F.split("text", "\t", 2)
        own = own.select(parts[0].cast("long").alias("doc_id"), parts[1].alias("text"))
        found = findings(own, ["doc_id"], "text", policy)
        writer = found.writeStream.format("parquet").option("path", f"{place}/out")
        query = writer.option("checkpointLocation", f"{place}/state").start()
        query.processAllAvailable()
        query.stop()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


def q_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Findings, JSON report and redacted texts, written and read back."""
    place = _workspace(spark)
    texts = documents(spark, sf)
    sinks.write_findings(findings(texts, ["doc_id"]), f"{place}/found")
    sinks.write_json_report(
        report.json_report(texts, ["doc_id"], F.col("doc_id")), f"{place}/json"
    )
    sinks.write_redacted(redacted(texts), f"{place}/redacted")
    found = spark.read.parquet(f"{place}/found").groupBy("doc_id").agg(F.count("*").alias("found"))
    lines = spark.read.schema("source string, clean boolean").json(f"{place}/json")
    clean = spark.read.parquet(f"{place}/redacted")
    return (
        clean.join(found, "doc_id", "left")
        .join(lines.withColumn("doc_id", F.col("source").cast("long")), "doc_id")
        .select(
            "doc_id",
            F.coalesce("found", F.lit(0)).cast("int").alias("n_findings"),
            "clean",
            "redacted",
        )
    )


def q_audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, the second one twice, with findings that more than one batch has seen."""
    log = AuditLog(f"{_workspace(spark)}/audit", ["doc_id"], "secret")
    place = f"{_workspace(spark)}/found"
    findings(documents(spark, sf), ["doc_id"]).write.parquet(place)
    found = spark.read.parquet(place)
    kept = {0: F.col("doc_id") % 2 == 0, 1: F.col("doc_id") % 3 == 0, 2: F.col("doc_id") % 5 == 0}
    for batch in (0, 1, 1, 2):
        log.append(found.where(kept[batch]), batch, "scanner" if batch < 2 else "gate")
    return (
        log.read(spark)
        .groupBy("batch", "actor", "action", "type", "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("n_events"))
    )


def queries() -> dict[str, Query]:
    detectors = {
        "q_email": one_detector("email", raw_documents),
        "q_phone": one_detector("phone-number", raw_documents),
        "q_credit_card": one_detector("credit-card", raw_documents),
        "q_email_spiked": one_detector("email"),
        "q_phone_spiked": one_detector("phone-number"),
        "q_credit_card_spiked": one_detector("credit-card"),
        "q_ssn": one_detector("ssn"),
        "q_aws_access_key": one_detector("aws-access-key"),
        "q_aws_secret_key": one_detector("aws-secret-key"),
        "q_github_pat": one_detector("github-pat"),
        "q_stripe_key": one_detector("stripe-key"),
        "q_google_api_key": one_detector("google-api-key"),
        "q_google_oauth": one_detector("google-oauth-secret"),
        "q_ssh_key": one_detector("ssh-private-key"),
        "q_jwt": one_detector("jwt"),
        "q_db_url": one_detector("db-connection-string"),
        "q_entropy": one_detector("high-entropy-string"),
        "q_iban": of_numbers(IBAN),
        "q_ipv6": of_numbers(IPV6),
        "q_min_severity_high": min_severity("high"),
        "q_min_severity_critical": min_severity("critical"),
    }
    named = {name: f for name, f in globals().items() if name.startswith("q_")}
    return {**detectors, **named}
