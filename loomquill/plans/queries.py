"""The engine's registered queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import config as C
from ..operators import extract, knowledge, pack, render, stats, tickets, turns
from ..sources import knowledge as bases
from ..sources import transcripts
from . import export

CONVERSATION_PACK = C.PackConfig(target=400, hard=500, least=100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as entries: session ``conv_id``, order ``turn``."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("role", "type")
    return extract.keep_conversation(rows).withColumn("tokens", X.estimate_tokens(F.col("text")))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.number_turns(_conversations(spark, sf_dir), "conv_id", "turn")


def role_filter(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.col("type").alias("role"), F.length("text").cast("long").alias("chars"))


def export_counters(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))).alias("line"))
    return stats.counters(transcripts.decode(lines)).select("total_entries", "filtered_entries")


def type_distribution(spark, sf_dir):
    return stats.type_distribution(table(spark, sf_dir, "conversations"), "role")


def event_distribution(spark, sf_dir):
    return stats.type_distribution(table(spark, sf_dir, "events"), "event_type")


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


def token_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", X.estimate_tokens(F.col("text")).alias("t"))
    return stats.token_totals(rows, "role", "t").select(F.col("kind").alias("role"), "tokens", F.col("n").alias("messages"))


def retained_tokens(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "user_text").when(F.col("role") == "assistant", "thinking").otherwise("tool_result")
    rows = table(spark, sf_dir, "conversations").select(kind.alias("kind"), X.estimate_tokens(F.col("text")).alias("t"))
    totals = stats.token_totals(rows, "kind", "t").filter("kind is not null").withColumn("retained", F.round("retained", 3))
    expected = stats.expected_chunks(totals, config=C.PackConfig(target=1000))
    return expected.select("kind", "tokens", "retained", F.round(X.real_tokens(F.col("tokens")), 3).alias("real_tokens"), "expected_chunks")


def turn_grouping(spark, sf_dir):
    return _numbered(spark, sf_dir).select("conv_id", "turn", "turn_id")


def turn_stats(spark, sf_dir):
    return stats.turn_stats(_numbered(spark, sf_dir), "conv_id")


def turn_triggers(spark, sf_dir):
    return turns.every_n_turns(_numbered(spark, sf_dir).filter("turn_id > 0").select("conv_id", "turn_id").distinct(), 2)


def _packed_documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.col("doc_id").alias("turn_id"), X.estimate_tokens(F.col("text")).alias("tokens"))
    return pack.pack(rows, "lang", "doc_id")


def pack_chunks(spark, sf_dir):
    return pack.chunk_stats(_packed_documents(spark, sf_dir), "lang").select("lang", "chunk_id", "turns", "tokens_est")


def pack_conversations(spark, sf_dir):
    rows = _numbered(spark, sf_dir).select("conv_id", "turn", "turn_id", "tokens")
    return pack.pack(rows, "conv_id", "turn", CONVERSATION_PACK).select("conv_id", "turn", "turn_id", "chunk_id")


def chunk_bounds(spark, sf_dir):
    return stats.bound_violations(pack.chunk_stats(_packed_documents(spark, sf_dir), "lang"))


def conversation_bounds(spark, sf_dir):
    """Out-of-bounds chunks of the conversations' packing, by its own constants."""
    rows = _numbered(spark, sf_dir).select("conv_id", "turn", "turn_id", "tokens")
    return stats.bound_violations(pack.chunk_stats(pack.pack(rows, "conv_id", "turn", CONVERSATION_PACK), "conv_id"), CONVERSATION_PACK)


def chunk_turn_numbers(spark, sf_dir):
    rows = _numbered(spark, sf_dir).select("conv_id", "turn", "turn_id", "tokens")
    packed = pack.pack(rows, "conv_id", "turn", CONVERSATION_PACK)
    return turns.turn_ordinals(packed, "conv_id").select("conv_id", "turn", F.col("turn_no").cast("long").alias("turn_no"))


def truncate_thinking(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", extract.cut_thinking(t).alias("summary"), (F.length(t) > C.THINKING_CAP).alias("truncated"))


def truncate_result(spark, sf_dir):
    t, failed = F.col("text"), F.col("doc_id") % 2 == 1
    return table(spark, sf_dir, "documents").select("doc_id", extract.cut_result(t, failed).alias("summary"), failed.alias("is_error"), (F.length(t) > C.RESULT_CAP).alias("truncated"))


def tool_inputs(spark, sf_dir):
    """Tool calls made of documents: the tool by id, the input's fields from the text."""
    names = F.array(*[F.lit(x) for x in ("Bash", "Edit", "Write", "Read", "Agent")])
    name = F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))
    t = F.col("text")
    made = F.to_json(F.struct(t.alias("command"), F.col("source").alias("file_path"), t.alias("old_string"), F.reverse(t).alias("new_string"), t.alias("content"), t.alias("prompt")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), extract.summarize_input(name, made).alias("summary"))


def events_incremental(spark, sf_dir):
    """Events as one file's lines, after a cursor at three quarters of the ids."""
    events = table(spark, sf_dir, "events").withColumns({"file": F.lit("events"), "line_num": F.col("event_id")})
    cursors = events.groupBy("file").agg((F.floor(F.max("event_id") * 3 / 4) + 1).alias("line_number"))
    return transcripts.after_cursors(events, cursors).select("event_id", "user_id", "event_type")


def cursor_verify(spark, sf_dir):
    """Each user's events as a file, and a cursor after the last one, every third of which names another event type."""
    lines = _user_files(spark, sf_dir)
    last = lines.groupBy("file").agg(F.count("*").alias("line_number"), F.max_by("event_type", "line_num").alias("event_type"), F.max("event_id").alias("event_id"))
    cursors = last.select("file", "line_number", F.when(F.col("file").cast("long") % 3 == 0, "moved").otherwise(F.col("event_type")).alias("uuid"), F.lit("").alias("timestamp"))
    state = F.when(F.col("state") == "unchanged", "ok").otherwise(F.col("state"))
    return export.file_status(lines, cursors).select("file", state.alias("state")).join(last, "file").select(F.col("file").cast("long").alias("user_id"), F.col("event_id").alias("line_number"), "state")


def _user_files(spark, sf_dir) -> DataFrame:
    """Events as lines of a file a user: ``file, line_num, line, event_type, event_id``."""
    events = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events.select(F.col("user_id").cast("string").alias("file"), number.cast("long").alias("line_num"), F.to_json(F.struct(F.col("event_type").alias("uuid"))).alias("line"), "event_type", "event_id")


def file_states(spark, sf_dir):
    """Users' files against cursors: none, at the end, beyond it, one line before it, and one that names another line."""
    lines = _user_files(spark, sf_dir)
    n = lines.groupBy("file").agg(F.count("*").alias("n"))
    kind = F.col("file").cast("long") % 5
    number = F.when(kind == 2, F.col("n") + 3).when(kind == 3, F.col("n") - 1).otherwise(F.col("n"))
    marked = n.filter(kind != 0).withColumn("line_number", number)
    seen = lines.select("file", (F.col("line_num") + 1).alias("line_number"), F.col("event_type").alias("uuid"))
    cursors = marked.join(seen, ["file", "line_number"], "left").select("file", "line_number", F.when(kind == 4, "moved").otherwise(F.coalesce("uuid", F.lit(""))).alias("uuid"), F.lit("").alias("timestamp"))
    return export.file_status(lines, cursors).select(F.col("file").cast("long").alias("user_id"), "line_count", "line_number", "state")


def latest_transcript(spark, sf_dir):
    """Users' files by their last event's time."""
    facts = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.max("ts").alias("last_modified"))
    return transcripts.latest_file(facts)


def recent_tail(spark, sf_dir):
    return turns.recent(table(spark, sf_dir, "documents").select("doc_id", "lang"), C.RECENT_LINES, None, "doc_id")


def _knowledge(spark, sf_dir) -> DataFrame:
    """Documents as knowledge entries: toxic ones deprecated, good ones verified, others drafts; category by source, topic by the text's beginning."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    status = F.when(F.col("toxic") == 1, "X").when(F.col("quality") == 1, "V").otherwise("D")
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    category = F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]), n % len(C.CATEGORIES) + 1)
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", "text", status.alias("status"), category.alias("category"), F.col("doc_id").alias("updated_at"))


def retention_status(spark, sf_dir):
    return knowledge.visible(_knowledge(spark, sf_dir)).select("doc_id", "status", "unverified", "safe_for_high_risk")


def status_winner(spark, sf_dir):
    rows = _knowledge(spark, sf_dir).withColumn("topic", F.left("text", F.lit(40)))
    return knowledge.winners(rows, "topic", tie="doc_id").select("doc_id", "status")


def index_summary(spark, sf_dir):
    return knowledge.index(_knowledge(spark, sf_dir))


def exact_dedup(spark, sf_dir):
    return knowledge.exact_groups(table(spark, sf_dir, "documents"), id="doc_id")


def near_dup_pairs(spark, sf_dir):
    """Pairs of similar texts among all documents, whatever their language label or beginning."""
    return knowledge.similar_pairs(table(spark, sf_dir, "documents"), id="doc_id").select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


def merge_classify(spark, sf_dir):
    """Even ids as existing entries, odd ones as incoming: same topic is language and the first 40 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("body"), F.col("source").alias("fact_value"), F.lit("source").alias("fact_key"), F.lit("D").alias("status"), F.col("doc_id").alias("updated_at"))
    got = knowledge.classify(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))
    return got.select("doc_id", "action")


def sync_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("body"), F.col("source").alias("fact_value"), F.lit("source").alias("fact_key"), F.lit("D").alias("status"), F.col("doc_id").alias("updated_at"))
    got = knowledge.classify(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))
    done = knowledge.sync_summary(got)
    return done.select("category", *[F.col(c).cast("long").alias(f"n_{c}") for c in ("new", "duplicate", "supplement", "conflict")])


def new_entries(spark, sf_dir):
    """Incoming texts (odd ids) that no existing one (even ids) equals."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return knowledge.truly_new(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")).select("doc_id")


def partial_read(spark, sf_dir):
    return knowledge.visible(knowledge.route(_knowledge(spark, sf_dir), "errors", "progress")).select("doc_id", "category", "status", "unverified")


def scope_counts(spark, sf_dir):
    return knowledge.in_scope(_knowledge(spark, sf_dir), "growth").groupBy("category", "status").agg(F.count("*").alias("n"))


def prefix_routing(spark, sf_dir):
    return knowledge.with_consumer(_knowledge(spark, sf_dir)).groupBy("consumer", "category").agg(F.count("*").alias("n"))


def history_totals(spark, sf_dir):
    """Orders as export history: one type for large ones, the other for small ones."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.when(F.col("o_orderkey") % 4 == 0, "full").otherwise("incremental").alias("type"), F.col("o_custkey").alias("entries_processed"), (F.col("o_orderkey") % 7).alias("knowledge_items_extracted"))
    return stats.history_totals(rows)


def malformed_lines(spark, sf_dir):
    """Event properties as lines, every fifth one broken off."""
    line = F.when(F.col("event_id") % 5 == 0, F.expr("left(props, greatest(length(props) - 1, 0))")).otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select(line.alias("line"))
    decoded = transcripts.decode(lines)
    return decoded.agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"), F.count_if(F.col("json").isNotNull()).alias("decoded"))


_TICKETS = [(1, "resolved", [], "research"), (2, "open", [1], "task"), (3, "open", [2], "task"), (4, "claimed", [], "task"), (5, "open", [], "prototype"), (6, "open", [1, 9], "task")]


def ticket_frontier(spark, sf_dir):
    rows = spark.createDataFrame(_TICKETS, "number int, status string, blocked_by array<int>, type string")
    return tickets.frontier(rows).select("number", "type")


def ticket_next(spark, sf_dir):
    rows = spark.createDataFrame(_TICKETS, "number int, status string, blocked_by array<int>, type string")
    return tickets.next_ticket(rows).select("number")


def triage_labels(spark, sf_dir):
    roles = spark.createDataFrame([(x,) for x in [*C.TRIAGE_LABELS, "other"]], "role string")
    return tickets.role_labels(roles, {x: x for x in C.TRIAGE_LABELS})


def session_order(spark, sf_dir):
    """Chronological position of each message over its session, by line order."""
    return turns.positions(_conversations(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "position")


def _entries(spark, sf_dir) -> DataFrame:
    """Documents as entries: every fourth one plain text, the others lists of a text, a thinking, an image, a tool call and its result."""
    t, id = F.col("text"), F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Bash", "Read", "Agent", "Grep")]), (id % 4 + 1).cast("int"))
    given = F.when(name == "Grep", F.to_json(F.struct(F.col("lang").alias("pattern"), id.alias("n")))).otherwise(F.to_json(F.struct(t.alias("command"), F.col("source").alias("file_path"), t.alias("prompt"))))
    block = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("type"), *more))
    call = F.concat(F.lit('{"type":"tool_use","name":"'), name, F.lit('","input":'), given, F.lit("}"))
    texts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("source").alias("text"))))
    result = F.when(id % 3 == 0, F.concat(F.lit('{"type":"tool_result","is_error":'), (id % 2 == 1).cast("string"), F.lit(',"content":'), texts, F.lit("}"))).otherwise(block("tool_result", t.alias("content"), (id % 2 == 1).alias("is_error")))
    listed = F.concat(F.lit("["), F.concat_ws(",", block("text", t.alias("text")), block("thinking", t.alias("thinking")), block("image"), call, result), F.lit("]"))
    plain = id % 4 == 0
    return table(spark, sf_dir, "documents").filter("text is not null").select(
        F.lit("documents").alias("file"), id.alias("line_num"), F.when(plain, "user").otherwise("assistant").alias("type"), F.when(plain, t).otherwise(listed).alias("content"), (~plain).alias("is_array"), "doc_id"
    )


def content_blocks(spark, sf_dir):
    parts = extract.content_parts(_entries(spark, sf_dir)).select("doc_id", F.posexplode("parts").alias("pos", "p"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("p.type").alias("kind"), F.col("p.text").alias("text"), F.col("p.truncated").alias("truncated"), F.coalesce("p.is_error", F.lit(False)).alias("is_error"))


def part_tokens(spark, sf_dir):
    return stats.part_tokens(extract.content_parts(_entries(spark, sf_dir))).select("doc_id", "tokens")


def block_distribution(spark, sf_dir):
    return stats.block_distribution(extract.content_parts(_entries(spark, sf_dir)))


def tool_distribution(spark, sf_dir):
    return stats.tool_distribution(extract.content_parts(_entries(spark, sf_dir)))


def fallback_parts(spark, sf_dir):
    """How many parts entries keep at each fallback level."""
    kept = extract.content_parts(_entries(spark, sf_dir))
    levels = [extract.drop_parts(kept, k).agg(F.lit(k).alias("level"), F.sum(F.size("parts")).alias("parts")) for k in range(3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def dropped_types(spark, sf_dir):
    return stats.dropped_types(table(spark, sf_dir, "conversations").withColumnRenamed("role", "type"))


def memory_entries(spark, sf_dir):
    """All conversations as one session held by the caller."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_num"), F.col("role").alias("type"), F.col("text").alias("content"))
    got = extract.content_parts(extract.keep_conversation(transcripts.from_memory(rows)))
    return got.select("file", "line_num", "type", F.col("parts")[0]["text"].alias("text"))


def line_slices(spark, sf_dir):
    """The second and third line of each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_num", "line"))
    return transcripts.slice_lines(lines, 1, 3).select("doc_id", F.col("line_num").cast("long").alias("line_num"), "line")


def paired_turns(spark, sf_dir):
    """User messages of every third place hold results only and belong to the turn before."""
    rows = _conversations(spark, sf_dir).withColumn("parts", F.array(F.struct(F.when((F.col("type") == "user") & (F.col("turn") % 3 == 2), "tool_result").otherwise("text").alias("type"), F.col("text").alias("text"))))
    return turns.number_turns(rows, "conv_id", "turn", paired=True).select("conv_id", "turn", "turn_id")


def _rendered(spark, sf_dir) -> DataFrame:
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(False).alias("truncated"), F.lit(None).cast("boolean").alias("is_error"))
    rows = _numbered(spark, sf_dir).select("conv_id", F.col("turn").alias("line_num"), "turn_id", "tokens", "type", F.lit("").alias("timestamp"), F.array(part).alias("parts"))
    return pack.pack(rows, "conv_id", "line_num", CONVERSATION_PACK)


def rendered_turns(spark, sf_dir):
    return render.render_turns(_rendered(spark, sf_dir), "conv_id").select("conv_id", "chunk_id", F.col("turn_no").cast("long").alias("turn_no"), "text")


def rendered_headers(spark, sf_dir):
    return render.render_headers(pack.chunk_stats(_rendered(spark, sf_dir), "conv_id", "timestamp"), "conv_id")


def headings(spark, sf_dir):
    """Headings of documents' sources: marked, unmarked, of another level, with an unknown mark."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("### [V] ", "### ", "## ", "### [Q] ")]), (F.col("doc_id") % 4 + 1).cast("int"))
    line = F.concat(mark, "source")
    return table(spark, sf_dir, "documents").select("doc_id", X.entry_status(line).alias("status"), X.entry_title(line).alias("title"))


def planning(spark, sf_dir):
    """Each conversation's share of a model's context and its price."""
    sums = _conversations(spark, sf_dir).groupBy("conv_id").agg(F.sum(F.when(F.col("type") == "user", F.col("tokens")).otherwise(0)).alias("a"), F.sum(F.when(F.col("type") == "user", 0).otherwise(F.col("tokens"))).alias("b"))
    return sums.select("conv_id", F.round(X.context_share(F.col("a") + F.col("b")), 9).alias("share"), F.round(X.cost(F.col("a"), F.col("b")), 9).alias("price"))


def item_times(spark, sf_dir):
    """Events as list items with a time, every seventh one without."""
    line = F.when(F.col("event_id") % 7 == 0, F.lit("- no time")).otherwise(F.concat(F.lit("- ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(X.item_time(line), "yyyy-MM-dd HH:mm").alias("at"))


def section_counts(spark, sf_dir):
    section = F.element_at(F.array(*[F.lit(x) for x in ("Done", "Open", "decided items")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return knowledge.section_counts(_knowledge(spark, sf_dir).withColumn("section", section))


def priorities(spark, sf_dir):
    section = F.element_at(F.array(*[F.lit(x) for x in ("High first", "medium", "LOW", "done", "else")]), (F.col("doc_id") % 5 + 1).cast("int"))
    items = table(spark, sf_dir, "documents").select("doc_id", section.alias("section"), F.col("doc_id").alias("title"))
    return knowledge.by_priority(items).select("doc_id", knowledge.priority(F.col("section")).alias("rank"))


def _titled(spark, sf_dir) -> DataFrame:
    return _knowledge(spark, sf_dir).withColumns({"title": F.col("doc_id").cast("string"), "section": F.lit("Open")})


def promoted(spark, sf_dir):
    """Evidence of four kinds, one of which proves nothing."""
    kb = _titled(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("user", "tool", "reference", "guess")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return knowledge.promote(kb, kb.filter("doc_id % 3 = 0").select("category", "title", kind.alias("kind"))).select("doc_id", "status")


def finished(spark, sf_dir):
    kb = _titled(spark, sf_dir)
    return knowledge.finish(kb, kb.filter("doc_id % 3 = 0").select("category", "title")).select("doc_id", "section")


def union_extractions(spark, sf_dir):
    """Drafts of two overlapping sets of documents as one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("facts").alias("category"), F.col("lang").alias("section"), F.col("source").alias("title"), F.col("text").alias("body"))
    return export.union_extractions(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 3 = 0")).groupBy("section").agg(F.count("*").alias("n"))


def merge_rules(spark, sf_dir):
    """Nations as entries, and by fives a duplicate, a supplement, a conflict, a new topic and a conflict with a verified entry."""
    n = table(spark, sf_dir, "nation").withColumn("r", F.col("n_nationkey") % 5)
    then, now = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-06-01 00:00:00").cast("timestamp")
    body = F.concat(F.lit("what is said of "), "n_name")
    same = {"category": F.lit("facts"), "section": F.lit(""), "created_at": then, "updated_at": then, "fact_key": F.lit("k")}
    names = ["category", "section", "status", "title", "body", "created_at", "updated_at", "fact_key", "fact_value"]
    old = n.withColumns(same | {"status": F.when(F.col("r") == 4, "V").otherwise("D"), "title": F.col("n_name"), "body": body, "fact_value": F.lit("v")}).select(names)
    new_title = F.when(F.col("r") == 3, F.concat(F.lit("more of "), "n_name")).otherwise(F.col("n_name"))
    new_body = F.when(F.col("r") == 0, F.upper(body)).when(F.col("r") == 1, F.concat(F.lit("another detail of "), "n_name")).when(F.col("r").isin(2, 4), F.concat(body, F.lit(" now"))).otherwise(body)
    new = n.withColumns(same | {"status": F.lit("D"), "title": new_title, "body": new_body, "fact_value": F.when(F.col("r").isin(2, 4), "w").otherwise("v")}).select(names)
    return knowledge.merge(old, new, now).select("title", "status", "body", "fact_value", (F.col("updated_at") == now).alias("refreshed"))


def markdown_round_trip(spark, sf_dir):
    """Nations as entries of categories by region, written as Markdown and parsed again."""
    category = F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]), (F.col("n_regionkey") % len(C.CATEGORIES) + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(c) for c in C.STATUSES]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    kb = table(spark, sf_dir, "nation").select(category.alias("category"), F.concat(F.lit("part "), F.col("n_nationkey") % 2).alias("section"), status.alias("status"), F.col("n_name").alias("title"), F.concat_ws("\n", F.lit("first"), F.col("n_nationkey").cast("string")).alias("body"))
    return bases.parse_markdown(bases.to_markdown(kb))


def ticket_resolved(spark, sf_dir):
    """The frontier after the second ticket is resolved."""
    rows = spark.createDataFrame(_TICKETS, "number int, status string, blocked_by array<int>, type string")
    return tickets.frontier(tickets.set_status(rows, 2, "resolved")).select("number", "type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pack_conversations, pack_chunks, chunk_bounds, conversation_bounds, chunk_turn_numbers, role_filter, export_counters, type_distribution, event_distribution, token_estimate, token_totals, retained_tokens,
        turn_grouping, turn_stats, turn_triggers, truncate_thinking, truncate_result, tool_inputs, events_incremental, cursor_verify, recent_tail, retention_status, status_winner, index_summary,
        exact_dedup, near_dup_pairs, merge_classify, sync_summary, new_entries, partial_read, scope_counts, prefix_routing, history_totals, malformed_lines, ticket_frontier, ticket_next, triage_labels, session_order,
        file_states, latest_transcript, content_blocks, part_tokens, block_distribution, tool_distribution, fallback_parts, dropped_types, memory_entries, line_slices, paired_turns, rendered_turns, rendered_headers,
        headings, planning, item_times, section_counts, priorities, promoted, finished, union_extractions, merge_rules, markdown_round_trip, ticket_resolved,
    )
}

_TOKENS = "CAST(floor(length(regexp_replace({0}, '[^一-鿿]', '', 'g')) + (length({0}) - length(regexp_replace({0}, '[^一-鿿]', '', 'g'))) / 4.0) AS BIGINT)"
_CONV = f"SELECT conv_id, turn, role, text, {_TOKENS.format('text')} AS tokens FROM conversations WHERE role IN ('user', 'assistant')"
_NUM = f"SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_id FROM ({_CONV})"
_CATEGORY = "CASE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 7 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(C.CATEGORIES)) + " END"
_KB = f"""SELECT d.doc_id, lang, text, CASE WHEN toxic = 1 THEN 'X' WHEN quality = 1 THEN 'V' ELSE 'D' END AS status, {_CATEGORY} AS category, d.doc_id AS updated_at
          FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"""
_SET = "list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> '')))"

#: Greedy packing, entry by entry: rows (session, ord, tok, turn_tok, first) in; (session, ord, raw, kind, turn_tok) out, kind 1 for pieces of oversized turns.
_FOLD = """
    o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS rn FROM e),
    f AS (
        SELECT session, ord, rn, tok, turn_tok, CAST(0 AS BIGINT) AS raw, tok AS size, CAST(CASE WHEN turn_tok > {hard} THEN 1 ELSE 0 END AS INT) AS kind FROM o WHERE rn = 1
        UNION ALL
        SELECT o.session, o.ord, o.rn, o.tok, o.turn_tok,
               f.raw + CASE WHEN {cut} THEN 1 ELSE 0 END, CASE WHEN {cut} THEN o.tok ELSE f.size + o.tok END, CAST(CASE WHEN o.turn_tok > {hard} THEN 1 ELSE 0 END AS INT)
        FROM f JOIN o ON o.session = f.session AND o.rn = f.rn + 1),
    c AS (SELECT session, raw, max(kind) AS kind, CAST(sum(tok) AS BIGINT) AS size FROM f GROUP BY session, raw),
    n AS (SELECT *, lead(kind) OVER w AS next_kind, lag(size) OVER w AS before FROM c WINDOW w AS (PARTITION BY session ORDER BY raw)),
    m AS (SELECT *, CASE WHEN kind = 0 AND size < {least} AND coalesce(next_kind, 1) = 1 AND before + size <= {hard} THEN 1 ELSE 0 END AS joins FROM n),
    ids AS (SELECT session, raw, raw - sum(joins) OVER (PARTITION BY session ORDER BY raw) AS chunk_id FROM m),
    packed AS (SELECT f.session, f.ord, f.tok, CAST(ids.chunk_id AS BIGINT) AS chunk_id FROM f JOIN ids USING (session, raw))"""
_CUT = "(CASE WHEN o.turn_tok > {hard} THEN o.first OR f.size + o.tok > {hard} ELSE o.first AND (f.kind = 1 OR f.size + o.turn_tok > {target}) END)"


def _fold_sql(c: C.PackConfig) -> str:
    cut = _CUT.format(hard=c.hard, target=c.target)
    return _FOLD.format(hard=c.hard, least=c.least, cut=cut)


_PACK_DOCS = f"WITH RECURSIVE e AS (SELECT lang AS session, doc_id AS ord, t AS tok, t AS turn_tok, true AS first FROM (SELECT lang, doc_id, {_TOKENS.format('text')} AS t FROM documents)), {_fold_sql(C.PackConfig())}"
_PACK_CONV = f"""WITH RECURSIVE e AS (SELECT conv_id AS session, turn AS ord, turn_id, tokens AS tok, CAST(sum(tokens) OVER (PARTITION BY conv_id, turn_id) AS BIGINT) AS turn_tok,
    row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY turn) = 1 AS first FROM ({_NUM})), {_fold_sql(CONVERSATION_PACK)}"""
_CLASSIFIED = f"""
    WITH r AS (SELECT doc_id, lang AS category, list_aggregate({_SET.format("left(text, 40)")}, 'string_agg', ' ') AS k, {_SET.format("text")} AS w, source FROM documents),
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, k ORDER BY doc_id DESC) AS rn FROM r WHERE doc_id % 2 = 0) WHERE rn = 1),
    m AS (SELECT n.doc_id, n.category, o.doc_id AS o, n.source AS s, o.source AS os, len(list_intersect(n.w, o.w)) AS b, len(n.w) AS x, len(o.w) AS y
          FROM r n LEFT JOIN old o ON n.category = o.category AND n.k = o.k WHERE n.doc_id % 2 = 1),
    a AS (SELECT doc_id, category, CASE WHEN o IS NULL THEN 'new' WHEN s <> os THEN 'conflict' WHEN x + y - b = 0 OR b / (x + y - b) > 0.9 THEN 'duplicate' ELSE 'supplement' END AS action FROM m)"""
_VALUES = ", ".join(f"({n}, '{s}', {b}::INT[], '{t}')" for n, s, b, t in _TICKETS)
_FRONTIER = f"WITH t(number, status, blocked_by, type) AS (VALUES {_VALUES}) SELECT CAST(number AS INT) AS number, type FROM t WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM unnest(blocked_by) AS u(b) WHERE b NOT IN (SELECT number FROM t WHERE status = 'resolved'))"
_JSON_CUT = "CASE doc_id % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Write' WHEN 3 THEN 'Read' ELSE 'Agent' END"

#: The parts of the entries made of documents: (doc_id, plain, pos, kind, text, truncated, is_error).
_CUT_RESULT = "CASE WHEN length(r) <= 600 THEN r WHEN doc_id % 2 = 1 THEN left(r, 500) || chr(10) || '[...error info...]' || chr(10) || right(r, 200) ELSE left(r, 500) || chr(10) || '[...omitted...]' END"
_PARTS = f"""
    WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || source ELSE text END AS r FROM documents WHERE text IS NOT NULL),
    parts AS (
        SELECT doc_id, true AS plain, 0 AS pos, 'text' AS kind, text, false AS truncated, CAST(NULL AS BOOLEAN) AS is_error FROM d WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, false, 0, 'text', text, false, NULL FROM d WHERE doc_id % 4 <> 0
        UNION ALL SELECT doc_id, false, 1, 'thinking', CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || '[...omitted...]' || chr(10) || right(text, 100) ELSE text END, length(text) > 400, NULL FROM d WHERE doc_id % 4 <> 0
        UNION ALL SELECT doc_id, false, 2, 'tool_use', CASE doc_id % 4 WHEN 1 THEN '[Tool: Read]' || chr(10) || 'File: ' || source WHEN 2 THEN '[Tool: Agent]' || chr(10) || 'Prompt: ' || left(text, 300)
                         ELSE '[Tool: Grep]' || chr(10) || 'Input: {{"pattern":"' || lang || '","n":' || doc_id || '}}' END, true, NULL FROM d WHERE doc_id % 4 <> 0
        UNION ALL SELECT doc_id, false, 3, 'tool_result', {_CUT_RESULT}, length(r) > 600, doc_id % 2 = 1 FROM d WHERE doc_id % 4 <> 0)"""
_RENDERED = f"{_PACK_CONV}, q AS (SELECT p.session AS conv_id, p.ord AS turn, p.chunk_id, p.tok, e.turn_id, dense_rank() OVER (PARTITION BY p.session, p.chunk_id ORDER BY e.turn_id) AS turn_no FROM packed p JOIN e ON e.session = p.session AND e.ord = p.ord)"
_USER_FILES = "n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"

ORACLE_SQL: dict[str, str] = {
    "role_filter": "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant')",
    "export_counters": "SELECT count(*) AS total_entries, count(*) FILTER (role IN ('user', 'assistant')) AS filtered_entries FROM conversations",
    "type_distribution": "SELECT role, count(*) AS n FROM conversations GROUP BY role ORDER BY n DESC, role",
    "event_distribution": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "token_estimate": f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "token_totals": f"SELECT role, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY ROLLUP (role)",
    "retained_tokens": f"""
        WITH t AS (SELECT CASE role WHEN 'user' THEN 'user_text' WHEN 'assistant' THEN 'thinking' ELSE 'tool_result' END AS kind, {_TOKENS.format("text")} AS t FROM conversations),
        s AS (SELECT kind, CAST(sum(t) AS BIGINT) AS tokens FROM t GROUP BY kind),
        r AS (SELECT kind, tokens, round(tokens * CAST(CASE kind WHEN 'user_text' THEN 1.0 WHEN 'thinking' THEN 0.3 ELSE 0.2 END AS DOUBLE), 3) AS retained FROM s)
        SELECT kind, tokens, retained, round(tokens * CAST(1.68 AS DOUBLE), 3) AS real_tokens, CAST(ceil(retained / 1000) AS BIGINT) AS expected_chunks FROM r""",
    "turn_grouping": f"SELECT conv_id, turn, turn_id FROM ({_NUM})",
    "turn_stats": f"SELECT conv_id, turn_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM ({_NUM}) GROUP BY conv_id, turn_id",
    "turn_triggers": f"SELECT DISTINCT conv_id, turn_id, CAST(floor((turn_id - 1) / 2.0) AS BIGINT) AS trigger_no FROM ({_NUM}) WHERE turn_id > 0",
    "pack_chunks": f"{_PACK_DOCS} SELECT session AS lang, chunk_id, count(*) AS turns, CAST(sum(tok) AS BIGINT) AS tokens_est FROM packed GROUP BY session, chunk_id",
    "pack_conversations": f"{_PACK_CONV} SELECT p.session AS conv_id, p.ord AS turn, e.turn_id, p.chunk_id FROM packed p JOIN e ON e.session = p.session AND e.ord = p.ord",
    "chunk_bounds": f"{_PACK_DOCS} SELECT count(*) AS chunks, count(*) FILTER (t < 40000) AS too_small, count(*) FILTER (t > 200000) AS too_large FROM (SELECT sum(tok) AS t FROM packed GROUP BY session, chunk_id)",
    "conversation_bounds": f"{_PACK_CONV} SELECT count(*) AS chunks, count(*) FILTER (t < {CONVERSATION_PACK.least}) AS too_small, count(*) FILTER (t > {CONVERSATION_PACK.hard}) AS too_large FROM (SELECT sum(tok) AS t FROM packed GROUP BY session, chunk_id)",
    "chunk_turn_numbers": f"{_PACK_CONV} SELECT p.session AS conv_id, p.ord AS turn, dense_rank() OVER (PARTITION BY p.session, p.chunk_id ORDER BY e.turn_id) AS turn_no FROM packed p JOIN e ON e.session = p.session AND e.ord = p.ord",
    "truncate_thinking": "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || '[...omitted...]' || chr(10) || right(text, 100) ELSE text END AS summary, length(text) > 400 AS truncated FROM documents",
    "truncate_result": """SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN doc_id % 2 = 1 THEN left(text, 500) || chr(10) || '[...error info...]' || chr(10) || right(text, 200)
        ELSE left(text, 500) || chr(10) || '[...omitted...]' END AS summary, doc_id % 2 = 1 AS is_error, length(text) > 600 AS truncated FROM documents""",
    "tool_inputs": f"""SELECT doc_id, {_JSON_CUT} AS name, CASE doc_id % 5
        WHEN 0 THEN 'Command: ' || left(text, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END
        WHEN 1 THEN 'File: ' || source || chr(10) || 'Old: ' || left(text, 100) || '...' || chr(10) || 'New: ' || left(reverse(text), 100) || '...'
        WHEN 2 THEN 'File: ' || source || chr(10) || 'Content: ' || left(text, 200) || '...'
        WHEN 3 THEN 'File: ' || source ELSE 'Prompt: ' || left(text, 300) END AS summary FROM documents""",
    "events_incremental": "SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT floor(max(event_id) * 3 / 4.0) FROM events)",
    "cursor_verify": "SELECT user_id, line_number, CASE WHEN user_id % 3 = 0 AND event_type <> 'moved' THEN 'changed' ELSE 'ok' END AS state FROM (SELECT user_id, max(event_id) AS line_number, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id)",
    "recent_tail": "SELECT doc_id, lang FROM documents WHERE doc_id > (SELECT max(doc_id) - 500 FROM documents)",
    "retention_status": f"SELECT doc_id, status, status = 'D' AS unverified, status = 'V' AS safe_for_high_risk FROM ({_KB}) WHERE status <> 'X'",
    "status_winner": f"SELECT doc_id, status FROM (SELECT *, row_number() OVER (PARTITION BY left(text, 40) ORDER BY CASE status WHEN 'V' THEN 0 WHEN 'D' THEN 1 ELSE 2 END, updated_at DESC, doc_id) AS r FROM ({_KB})) WHERE r = 1",
    "index_summary": f"SELECT category, count(*) AS entries, max(updated_at) AS last_updated FROM ({_KB}) WHERE status <> 'X' GROUP BY ROLLUP (category)",
    "exact_dedup": "SELECT md5(text) AS text_key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY md5(text)",
    "near_dup_pairs": f"""
        WITH d AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text), s AS (SELECT id, {_SET.format("text")} AS w FROM d),
        o AS (SELECT id, len(w) AS n, unnest(w) AS word FROM s), c AS (SELECT word, count(*) AS k FROM o GROUP BY word),
        r AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY k, word) AS place FROM o JOIN c USING (word)),
        x AS (SELECT id, n, word FROM r WHERE place <= n - ceil(0.9 * n) + 1),
        m AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) > 0.9 * greatest(a.n, b.n)),
        p AS (SELECT id_a, id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS t FROM m JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b)
        SELECT id_a, id_b, round(i / (t - i), 9) AS similarity FROM p WHERE i / (t - i) > 0.9""",
    "merge_classify": f"{_CLASSIFIED} SELECT doc_id, action FROM a",
    "sync_summary": f"{_CLASSIFIED} SELECT category, count(*) FILTER (action = 'new') AS n_new, count(*) FILTER (action = 'duplicate') AS n_duplicate, count(*) FILTER (action = 'supplement') AS n_supplement, count(*) FILTER (action = 'conflict') AS n_conflict FROM a GROUP BY category",
    "new_entries": "SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.text = d.text)",
    "partial_read": f"SELECT doc_id, category, status, status = 'D' AS unverified FROM ({_KB}) WHERE status <> 'X' AND category IN ('pitfalls', 'state')",
    "scope_counts": f"SELECT category, status, count(*) AS n FROM ({_KB}) WHERE category IN ('growth-notes', 'prompt-improvements') GROUP BY category, status",
    "prefix_routing": f"SELECT CASE WHEN category IN ('facts', 'pitfalls', 'state') THEN 'AI' WHEN category IN ('growth-notes', 'prompt-improvements') THEN 'Human' ELSE 'Human+AI' END AS consumer, category, count(*) AS n FROM ({_KB}) GROUP BY category",
    "history_totals": """SELECT count(*) AS exports, count(*) FILTER (o_orderkey % 4 = 0) AS "full", count(*) FILTER (o_orderkey % 4 <> 0) AS incremental, CAST(sum(o_custkey) AS BIGINT) AS entries, CAST(sum(o_orderkey % 7) AS BIGINT) AS knowledge_items FROM orders""",
    "malformed_lines": """
        WITH l AS (SELECT CASE WHEN event_id % 5 = 0 THEN left(props, greatest(length(props) - 1, 0)) ELSE props END AS line FROM events),
        v AS (SELECT line, json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT' AS good FROM l)
        SELECT count(*) AS lines, count(*) FILTER (line ~ '\\S' AND NOT coalesce(good, false)) AS malformed, count(*) FILTER (good) AS decoded FROM v""",
    "ticket_frontier": _FRONTIER,
    "ticket_next": f"SELECT min(number) AS number FROM ({_FRONTIER})",
    "triage_labels": "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{x}')" for x in C.TRIAGE_LABELS) + ", ('other', NULL)) AS t(role, label)",
    "session_order": f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM ({_CONV})",
    "file_states": f"""
        WITH {_USER_FILES} SELECT user_id, n AS line_count, CASE user_id % 5 WHEN 0 THEN 0 WHEN 2 THEN n + 3 WHEN 3 THEN n - 1 ELSE n END AS line_number,
        CASE user_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'truncated' WHEN 3 THEN 'grown' ELSE 'changed' END AS state FROM n""",
    "latest_transcript": "SELECT CAST(user_id AS VARCHAR) AS file FROM events GROUP BY user_id ORDER BY max(ts) DESC, CAST(user_id AS VARCHAR) DESC LIMIT 1",
    "content_blocks": f"{_PARTS} SELECT doc_id, pos, kind, text, truncated, coalesce(is_error, false) AS is_error FROM parts",
    "part_tokens": f"{_PARTS} SELECT doc_id, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM parts GROUP BY doc_id",
    "block_distribution": f"{_PARTS} SELECT CASE WHEN plain THEN 'user' ELSE 'assistant' END AS type, kind AS block, count(*) AS n FROM parts GROUP BY ALL",
    "tool_distribution": "SELECT CASE doc_id % 4 WHEN 1 THEN 'Read' WHEN 2 THEN 'Agent' ELSE 'Grep' END AS name, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0 GROUP BY 1",
    "fallback_parts": f"{_PARTS} SELECT level, count(*) FILTER (level = 0 OR kind = 'text' OR (level = 1 AND kind = 'tool_use')) AS parts FROM parts, (VALUES (0), (1), (2)) AS l(level) GROUP BY level",
    "dropped_types": "SELECT role AS type, CASE role WHEN 'system' THEN 'system notice' WHEN 'mode' THEN 'setting' WHEN 'attachment' THEN 'binary' ELSE 'unknown' END AS reason, count(*) AS n FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY role",
    "memory_entries": "SELECT 'memory' AS file, conv_id * 1000 + turn AS line_num, role AS type, text FROM conversations WHERE role IN ('user', 'assistant')",
    "line_slices": "SELECT doc_id, i - 1 AS line_num, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), (VALUES (2), (3)) AS v(i) WHERE len(l) >= i",
    "paired_turns": f"SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' AND turn % 3 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_id FROM ({_CONV})",
    "rendered_turns": f"""{_RENDERED} SELECT q.conv_id, q.chunk_id, q.turn_no, '## [Turn ' || q.turn_no || '] ' || chr(10) || chr(10)
        || string_agg(CASE c.role WHEN 'user' THEN '### User:' ELSE '### Assistant:' END || chr(10) || c.text, chr(10) || chr(10) ORDER BY c.turn) || chr(10) || chr(10) || '---' || chr(10) AS text
        FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn GROUP BY q.conv_id, q.chunk_id, q.turn_no""",
    "rendered_headers": f"""{_RENDERED}, s AS (SELECT conv_id, chunk_id, count(DISTINCT turn_id) AS n, CAST(sum(tok) AS BIGINT) AS t FROM q GROUP BY conv_id, chunk_id)
        SELECT conv_id, chunk_id, '# Conversation History Export - Chunk ' || chunk_id || '/' || max(chunk_id) OVER (PARTITION BY conv_id) || chr(10) || chr(10) || '> Time range:  ~ ' || chr(10)
        || '> Estimated tokens: ~' || format('{{:,}}', t) || chr(10) || '> Conversation turns: ' || n || chr(10) || chr(10) || '---' || chr(10) AS text FROM s""",
    "headings": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'V' WHEN 2 THEN NULL ELSE 'D' END AS status, CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '[Q] ' || source ELSE source END AS title FROM documents",
    "planning": f"""SELECT conv_id, round(((a + b) * CAST(1.68 AS DOUBLE) + 38000) / 1000000, 9) AS share, round(a * CAST(3 AS DOUBLE) / 1000000 + b * CAST(15 AS DOUBLE) / 1000000, 9) AS price
        FROM (SELECT conv_id, CAST(coalesce(sum(tokens) FILTER (role = 'user'), 0) AS BIGINT) AS a, CAST(coalesce(sum(tokens) FILTER (role <> 'user'), 0) AS BIGINT) AS b FROM ({_CONV}) GROUP BY conv_id)""",
    "item_times": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS at FROM events",
    "section_counts": f"SELECT category, count(*) FILTER (doc_id % 3 = 1) AS open, count(*) FILTER (doc_id % 3 <> 1) AS done FROM ({_KB}) WHERE status <> 'X' GROUP BY category",
    "priorities": "SELECT doc_id, CAST(doc_id % 5 AS INT) AS rank FROM documents",
    "promoted": f"SELECT doc_id, CASE WHEN status = 'D' AND doc_id % 3 = 0 AND doc_id % 4 <> 3 THEN 'V' ELSE status END AS status FROM ({_KB})",
    "finished": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Done' ELSE 'Open' END AS section FROM documents",
    "union_extractions": "SELECT lang AS section, count(*) AS n FROM (SELECT DISTINCT lang, source, text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) GROUP BY lang",
    "merge_rules": """
        WITH n AS (SELECT n_name AS t, 'what is said of ' || n_name AS b, n_nationkey % 5 AS r FROM nation)
        SELECT t AS title, CASE r WHEN 2 THEN 'X' WHEN 4 THEN 'V' ELSE 'D' END AS status, CASE r WHEN 1 THEN b || chr(10) || 'another detail of ' || t ELSE b END AS body, 'v' AS fact_value, r IN (0, 1, 2) AS refreshed FROM n
        UNION ALL SELECT t, 'D', b || ' now', 'w', true FROM n WHERE r IN (2, 4) UNION ALL SELECT 'more of ' || t, 'D', b, 'v', true FROM n WHERE r = 3""",
    "markdown_round_trip": "SELECT CASE n_regionkey % 7 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(C.CATEGORIES)) + " END AS category, 'part ' || (n_nationkey % 2) AS section, CASE n_nationkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'V' ELSE 'X' END AS status, n_name AS title, 'first' || chr(10) || n_nationkey AS body FROM nation",
    "ticket_resolved": _FRONTIER.replace("(2, 'open'", "(2, 'resolved'"),
}
