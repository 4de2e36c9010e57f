"""The registered queries: name to ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions import labels, overlap, safety, text, vectors
from hearth.functions.facts import extract_facts
from hearth.functions.prompts import fallback_response
from hearth.operators import cells, corpus, memory, metrics, nearest, ordering
from hearth.operators.store import KeyedStore
from hearth.plans import jobs, views
from hearth.session import materialised, scratch_path
from hearth.sources import requests, tables
from hearth.streaming import turns as streams

NO_REPLY = "generation disabled"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _joined(vector: F.Column, digits: int = 5) -> F.Column:
    """A vector as text, for comparison."""
    return F.array_join(F.transform(vector, lambda x: F.format_number(x.cast("double"), digits)), " ")


# ---- scans, sinks ---------------------------------------------------------------


def _written_splits(spark: SparkSession, folder: str) -> str:
    """Raw dialogues as three split files with three delimiters, below a new folder."""
    raw = views.raw_dialogues(spark, folder)
    raw = raw.withColumn("doc_id", F.col("doc_id").cast("string"))
    path = scratch_path(spark, "splits")
    for i, (name, sep) in enumerate([("train.csv", ","), ("dev.csv", ";"), ("test.csv", "\t")]):
        part = raw.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i)
        options = {"header": True, "sep": sep, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        part.write.options(**options).csv(f"{path}/{name}")
    return path


@query
def scan_csv_tolerant(spark, folder):
    return tables.scan_corpus_splits(spark, _written_splits(spark, folder)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "context", "utterance", "emotion"
    )


@query
def corpus_roundtrip(spark, folder):
    path = scratch_path(spark, "corpus")
    tables.write_csv(corpus.dedup_corpus(corpus.clean_corpus(views.raw_dialogues(spark, folder))), path)
    return tables.read_written_csv(spark, path, "text string, emotion string")


@query
def load_pairs_limited(spark, folder):
    """The first 100 pairs, counted before those with a blank side go."""
    response = F.when(F.col("conv_id") % 9 == 0, "  ").otherwise(F.col("bot_response"))
    rows = views.turns(spark, folder).select("conv_id", "turn", F.col("user_message").alias("text"), response.alias("response"))
    return tables.load_pairs(rows, limit=100, order_by=["conv_id", "turn"])


@query
def collection_upsert(spark, folder):
    """Documents stored under their text's digest, then offered again with other copies."""
    docs = views.table(spark, folder, "documents")
    key = F.md5("text").alias("id")
    stored = docs.filter(F.col("lang") == "en").groupBy(key).agg(F.min("doc_id").alias("doc_id"))
    offered = docs.groupBy(key).agg(F.max("doc_id").alias("doc_id"))
    return memory.upsert(stored, offered)


@query
def collection_count(spark, folder):
    return views.table(spark, folder, "documents").agg(F.count("*").alias("size"))


@query
def metric_report_long(spark, folder):
    return tables.metric_report(_rounded(metrics.emotion_alignment(views.emotion_pairs(spark, folder))))


@query
def chat_requests_parse(spark, folder):
    parsed = requests.parse_requests(views.request_bodies(spark, folder))
    return parsed.select("turn_id", "message", "use_filter", "user_id", "conversation_id", "accepted")


@query
def chat_result_json(spark, folder):
    """Results of whole turns: retrieval and guard of each, and the memory with all of them saved."""
    stored = _stored_memory(spark, folder)
    done = _chat_turns(spark, folder, stored)
    saved = stored.select(F.col("id").alias("query_id"), F.lit(True).alias("conversation_saved"))
    stats = memory.memory_stats(stored).select("user_id", F.struct("total", "conversations", "facts").alias("memory_stats"))
    none = F.lit(None).cast("string")
    whole = done.join(saved, "query_id", "left").fillna({"conversation_saved": False}).join(stats, "user_id", "left")
    rows = whole.select(
        "query_id",
        "emotion",
        F.col("final_text").alias("response"),
        "toxic",
        F.col("scores").alias("toxicity_scores"),
        "context",
        "use_filter",
        F.col("used_fallback").alias("using_fallback"),
        (~F.col("used_fallback")).alias("llm_enabled"),
        F.when(F.col("used_fallback"), NO_REPLY).alias("llm_error"),
        none.alias("llm_model"),
        none.alias("llm_candidates"),
        requests.filter_applied("use_filter", "toxic", "scores").alias("filter_applied"),
        "memories_used",
        "conversation_saved",
        "memory_stats",
    )
    return rows.select("query_id", requests.result_json(rows).alias("body"))


# ---- corpus -----------------------------------------------------------------------


@query
def infer_text_column(spark, folder):
    raw = views.raw_dialogues(spark, folder)
    return raw.select("doc_id", corpus.infer_text(raw).alias("text"))


@query
def infer_text_for_index(spark, folder):
    raw = views.raw_dialogues(spark, folder).select("doc_id", "context", F.col("utterance").alias("response"))
    return raw.select("doc_id", corpus.infer_index_text(raw).alias("text"))


@query
def derive_emotion_label(spark, folder):
    raw = views.raw_dialogues(spark, folder).drop("emotion")
    return raw.select("doc_id", corpus.infer_emotion(raw).alias("emotion"))


@query
def strip_label_token(spark, folder):
    return views.raw_dialogues(spark, folder).select("doc_id", labels.strip_label_token("context").alias("context"))


@query
def clean_corpus(spark, folder):
    return corpus.clean_corpus(views.raw_dialogues(spark, folder))


@query
def dedup_corpus(spark, folder):
    return corpus.dedup_corpus(corpus.clean_corpus(views.raw_dialogues(spark, folder)))


@query
def union_splits(spark, folder):
    raw = views.raw_dialogues(spark, folder)
    halves = [raw.select("doc_id", "context"), raw.select("doc_id", "utterance", "emotion")]
    return tables.union_splits(halves)


@query
def taxonomy_filter(spark, folder):
    raw = views.raw_dialogues(spark, folder)
    known = corpus.keep_taxonomy(raw.withColumn("emotion", text.strip_blanks(F.lower("emotion"))))
    return known.select("doc_id", "emotion")


@query
def synonym_join(spark, folder):
    raw = views.raw_dialogues(spark, folder).select("doc_id", F.lower(text.first_token(F.col("emotion"))).alias("token"))
    return corpus.canonical_labels(raw, labels.synonym_table(spark), "corpus", "token").select("doc_id", "token", "canonical")


@query
def unmapped_labels(spark, folder):
    raw = views.raw_dialogues(spark, folder)
    return corpus.unmapped_labels(raw.withColumn("emotion", F.lower(F.trim("emotion"))), labels.taxonomy_table(spark))


@query
def typo_audit(spark, folder):
    return corpus.typo_audit(views.raw_dialogues(spark, folder), "utterance")


@query
def label_distribution(spark, folder):
    return corpus.label_distribution(corpus.dedup_corpus(corpus.clean_corpus(views.raw_dialogues(spark, folder))))


@query
def dense_doc_ids(spark, folder):
    numbered = ordering.with_dense_index(views.table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return numbered.select(F.concat(F.lit("doc-"), F.col("index").cast("string")).alias("id"), "doc_id", "n_chars")


# ---- text functions ------------------------------------------------------------------


@query
def clean_text(spark, folder):
    return views.raw_dialogues(spark, folder).select("doc_id", text.clean_text("utterance").alias("text"))


@query
def normalize_emotion(spark, folder):
    return views.raw_dialogues(spark, folder).select("doc_id", labels.normalize_emotion("emotion").alias("emotion"))


@query
def normalize_model_label(spark, folder):
    return views.raw_dialogues(spark, folder).select("doc_id", labels.normalize_model_label("emotion").alias("emotion"))


@query
def prefix_text(spark, folder):
    return views.table(spark, folder, "documents").select(
        "doc_id",
        text.with_prefix(C.QUERY_PREFIX, "text").alias("query"),
        text.with_prefix(C.PASSAGE_PREFIX, "text").alias("passage"),
        text.with_prefix(C.LABEL_PREFIX, "text").alias("labelled"),
    )


@query
def ellipsis_snippet(spark, folder):
    return views.table(spark, folder, "documents").select(
        "doc_id", text.snippet("text").alias("snippet"), text.title("text").alias("title")
    )


@query
def hash_embed(spark, folder):
    return views.collection(spark, folder).select("id", _joined(F.col("embedding")).alias("embedding"))


@query
def l2_normalize(spark, folder):
    doubled = F.transform("embedding", lambda x: x.cast("double") * F.col("id"))
    return views.vectors(spark, folder).select("id", _joined(vectors.l2_normalize(doubled)).alias("embedding"))


@query
def extract_facts_per_message(spark, folder):
    return views.messages(spark, folder).select(
        "message_id", F.array_join(extract_facts("user_message"), "; ").alias("facts")
    )


QUERIES["extract_facts"] = QUERIES.pop("extract_facts_per_message")


# ---- retrieval ---------------------------------------------------------------------------


@query
def knn_topk(spark, folder):
    v = views.vectors(spark, folder)
    return nearest.nearest(v, v, 5, "id", "id", skip_self=True)


@query
def knn_topk_blocks(spark, folder):
    """The same answer by block pairs instead of a broadcast."""
    v = views.vectors(spark, folder)
    return nearest.nearest(v, v, 5, "id", "id", skip_self=True, broadcast_bytes=0, block_rows=400)


@query
def knn_clustered_exact(spark, folder):
    """The same answer by k-means cells and the triangle inequality."""
    v = views.vectors(spark, folder)
    return cells.nearest_clustered(v, v, 5, 8, 2, True, "id", skip_self=True)


@query
def knn_lsh_recall(spark, folder):
    """Whether six of eight stored cells hold nine tenths of the true neighbours."""
    v = views.vectors(spark, folder)
    index = cells.CellIndex(spark, scratch_path(spark, "vector-cells")).build(v.select("id", "embedding"), 8)
    found = index.nearest(v, 5, 6, exact=False, query_id="id", skip_self=True)
    report = nearest.recall(found, nearest.nearest(v, v, 5, "id", "id", skip_self=True))
    return report.select("truth_rows", (F.col("recall") >= 0.9).alias("recalled"))


@query
def knn_per_user(spark, folder):
    v = views.vectors(spark, folder)
    hits = nearest.nearest(v, v, 10, "id", "id", by="user_id", skip_self=True)
    return hits.withColumn("relevance", vectors.relevance("distance"))


_INDEXES: dict[tuple[str, str], cells.CellIndex] = {}


def _index(spark, folder) -> cells.CellIndex:
    """The documents as a stored index, built when a session first asks for it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        _INDEXES[key] = cells.CellIndex(spark, scratch_path(spark, "index")).build(views.collection(spark, folder), 16)
    return _INDEXES[key]


@query
def retrieve_contexts(spark, folder):
    """Contexts from the stored index: cells that cannot hold one are not read."""
    hits = jobs.retrieve_contexts(_requests(spark, folder), _index(spark, folder), n_probe=6)
    return hits.select("query_id", "rank", "id", "distance", "document")


@query
def context_block(spark, folder):
    contexts = jobs.retrieve_contexts(_requests(spark, folder), _index(spark, folder).rows())
    return jobs.context_block(contexts)


@query
def collection_append(spark, folder):
    """Documents with metadata stored twice under their text's digest: what was stored first stays."""
    docs = views.texts(spark, folder)
    store = KeyedStore(spark, scratch_path(spark, "collection"), buckets=32)

    def wave(rows, number):
        metadata = F.create_map(F.lit("wave"), F.lit(number), F.lit("source"), F.col("source"))
        return rows.select(F.md5("text").alias("id"), F.col("text").alias("document"), vectors.hash_embed("text", prefix=C.PASSAGE_PREFIX).alias("embedding"), metadata.alias("metadata"))

    store.append(wave(docs.filter("lang = 'en'"), "1"))
    store.append(wave(docs, "2"))
    found = store.read()
    return found.select("id", F.col("metadata")["wave"].alias("wave"), F.col("metadata")["source"].alias("source"), F.length("document").alias("n_chars"))


@query
def index_build(spark, folder):
    raw = views.texts(spark, folder).select("doc_id", "text")
    return jobs.build_index(raw, "doc_id").select("id", "document", _joined(F.col("embedding")).alias("embedding"))


@query
def pair_join(spark, folder):
    pairs = views.reply_pairs(spark, folder)
    return metrics.pair_on_id(pairs.select("row_id", "pred"), pairs.select("row_id", "ref"))


# ---- memory ------------------------------------------------------------------------------------


def _memory(spark, folder):
    """Turns of the conversations and facts of the messages as one memory table."""
    turns = memory.turn_records(views.turns(spark, folder))
    return turns.unionByName(memory.extracted_fact_records(views.messages(spark, folder)))


@query
def turn_pairs(spark, folder):
    return memory.pair_turns(views.table(spark, folder, "conversations"))


@query
def memory_turns(spark, folder):
    return memory.turn_records(views.turns(spark, folder)).select(
        "id", "user_id", "conversation_id", "type", "document", "user_message", "bot_response", "emotion",
        _stamp("created_at").alias("created_at"),
    )


@query
def memory_facts(spark, folder):
    return memory.extracted_fact_records(views.messages(spark, folder)).select(
        "id", "user_id", "type", "document", _stamp("created_at").alias("created_at")
    )


@query
def memory_stats(spark, folder):
    users = views.table(spark, folder, "customer").select((F.col("c_custkey") % 30).cast("string").alias("user_id"))
    return memory.memory_stats(_memory(spark, folder), users)


@query
def memory_listing(spark, folder):
    return memory.memory_listing(_memory(spark, folder))


@query
def memory_clear_user(spark, folder):
    nations = views.table(spark, folder, "nation").filter("n_regionkey = 1")
    cleared = nations.select(F.col("n_nationkey").cast("string").alias("user_id"))
    return memory.clear_users(_memory(spark, folder), cleared).select("id", "user_id", "type")


def _stored_memory(spark, folder):
    """The memory as retrieval finds it: a stored table, not text to be embedded again."""
    return materialised(_memory(spark, folder), "memory")


def _memory_store(spark, folder) -> KeyedStore:
    store = memory.memory_store(spark, scratch_path(spark, "memory"), buckets=16)
    memory.save_memory(store, _memory(spark, folder))
    return store


def _some_users(spark, folder):
    nations = views.table(spark, folder, "nation").filter("n_regionkey = 1")
    return nations.select(F.col("n_nationkey").cast("string").alias("user_id"))


@query
def memory_save(spark, folder):
    """Turns and facts that a save has stored per user, and what storing them again adds."""
    store = _memory_store(spark, folder)
    first = memory.saved_per_user(store, store.listing().number)
    again = memory.save_memory(store, _memory(spark, folder))
    return first.select("user_id", "turns", "facts", F.lit(again.saved).cast("long").alias("again"))


@query
def memory_delete_stored(spark, folder):
    """The stored memory after users were deleted from its files."""
    store = _memory_store(spark, folder)
    store.delete(_some_users(spark, folder))
    return store.read().select("id", "user_id", "type")


@query
def memory_user_lookup(spark, folder):
    """Stored records of some users; only their buckets are read."""
    return _memory_store(spark, folder).of(_some_users(spark, folder)).select("id", "user_id", "type", "document")


def _requests(spark, folder):
    """User messages with their vectors, stored since every step of a turn reads them."""
    return materialised(views.turn_queries(spark, folder), "requests")


def _memory_hits(spark, folder, requests=None):
    asked = requests if requests is not None else _requests(spark, folder)
    return materialised(memory.retrieve_memories(asked, _stored_memory(spark, folder), asked_at="asked_at"), "hits")


@query
def memory_hits(spark, folder):
    return _memory_hits(spark, folder).select(
        "query_id", "rank", "id", "type", "content", "emotion", "distance", "relevance"
    )


@query
def memory_prompt_lines(spark, folder):
    return memory.memory_prompt_lines(_memory_hits(spark, folder)).select("query_id", "slot", "id", "type")


@query
def memory_block(spark, folder):
    return memory.memory_block(_memory_hits(spark, folder))


@query
def preview_with_overflow(spark, folder):
    lines = _memory(spark, folder).select("user_id", "id", "created_at", memory.listing_line().alias("line"))
    order = [F.desc("created_at"), F.col("id")]
    return ordering.preview_with_overflow(lines, "user_id", order, "line", C.PREVIEW_ITEMS)


@query
def conversation_summary(spark, folder):
    return memory.conversation_summary(views.table(spark, folder, "conversations"))


# ---- prompts and safety -----------------------------------------------------------------------


@query
def prompt_table(spark, folder):
    queries = _requests(spark, folder)
    contexts = jobs.retrieve_contexts(queries, _index(spark, folder).rows())
    asked = queries.select("query_id", "message", "emotion", F.col("use_filter").alias("safety_mode"))
    return jobs.prompt_table(asked, contexts, memory.memory_block(_memory_hits(spark, folder, queries)))


@query
def fallback_reply(spark, folder):
    turns = views.turns(spark, folder)
    reason = F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return turns.select("turn_id", fallback_response("emotion", reason).alias("response"))


QUERIES["fallback_response"] = QUERIES.pop("fallback_reply")


@query
def lexicon_toxicity(spark, folder):
    docs = views.texts(spark, folder)
    scored = docs.select("doc_id", safety.lexicon_scores("text", views.TEST_LEXICON).alias("scores"))
    word = F.get(F.map_keys("scores"), F.lit(0))
    return scored.select("doc_id", (F.size("scores") > 0).alias("toxic"), F.coalesce(word, F.lit("")).alias("word"))


@query
def score_map_toxicity(spark, folder):
    scored = views.toxicity_scores(spark, folder)
    return scored.select(
        "doc_id",
        F.round(safety.max_score("scores"), 6).alias("max_score"),
        safety.is_toxic_scores("scores").alias("toxic"),
    )


@query
def sanitize(spark, folder):
    scored = views.toxicity_scores(spark, folder)
    guarded = safety.guard(scored, "text", scores=F.col("scores"))
    return guarded.select("doc_id", "toxic", "final_text")


def _chat_turns(spark, folder, stored):
    queries = _requests(spark, folder)
    replies = queries.filter(F.col("bot_response").isNotNull()).select("query_id", F.col("bot_response").alias("reply"))
    asked = queries.drop("bot_response")
    return jobs.chat_turns(asked, stored, _index(spark, folder).rows(), replies, NO_REPLY, views.TEST_LEXICON)


@query
def chat_turns(spark, folder):
    """Retrieval, prompt, reply and guard of every turn as one plan."""
    done = _chat_turns(spark, folder, _stored_memory(spark, folder))
    return done.select("query_id", "memories_used", "used_fallback", "toxic", "final_text", F.md5("prompt").alias("prompt_md5"))


# ---- metrics ---------------------------------------------------------------------------------------


@query
def bleu_corpus(spark, folder):
    report = metrics.bleu(views.reply_pairs(spark, folder))
    return report.withColumn("bleu", F.round("bleu", 6)).withColumn("brevity_penalty", F.round("brevity_penalty", 6))


def _rounded(report: DataFrame) -> DataFrame:
    doubles = [f.name for f in report.schema if f.dataType.simpleString() == "double"]
    return report.withColumns({n: F.round(n, 6) for n in doubles})


@query
def rouge_l(spark, folder):
    return _rounded(metrics.rouge_l(views.reply_pairs(spark, folder), stem=False))


@query
def rouge_l_stemmed(spark, folder):
    return _rounded(metrics.rouge_l(views.reply_pairs(spark, folder)))


@query
def greedy_match_score(spark, folder):
    return _rounded(metrics.greedy_match_score(views.token_vectors(spark, folder), fallback="used_fallback"))


@query
def emotion_alignment(spark, folder):
    return _rounded(metrics.emotion_alignment(views.emotion_pairs(spark, folder)))


@query
def toxicity_reduction(spark, folder):
    return _rounded(metrics.toxicity_reduction(views.toxicity_scores(spark, folder)))


def _evaluation_rows(spark, folder):
    turns = _requests(spark, folder).filter(F.col("bot_response").isNotNull())
    pairs = turns.select("query_id", F.col("message").alias("text"), F.col("bot_response").alias("response"), "emotion", "embedding")
    replies = turns.filter("use_filter").select("query_id", F.col("bot_response").alias("reply"))
    return jobs.evaluation_rows(pairs, _index(spark, folder).rows(), replies, words=views.TEST_LEXICON, reason=NO_REPLY)


@query
def evaluation_run(spark, folder):
    """Retrieve, respond, guard and pair every turn that has a reply."""
    rows = _evaluation_rows(spark, folder)
    return rows.select("row_id", "pred", "ref", "used_fallback", "toxic", F.md5("prompt").alias("prompt_md5"))


@query
def evaluation_report(spark, folder):
    """Every column of the reports on the evaluation run's predictions: BLEU, ROUGE-L over stems, toxicity."""
    rows = materialised(_evaluation_rows(spark, folder).select("pred", "ref", "used_fallback", "scores"), "predictions")
    used = "used_fallback"
    reports = [metrics.bleu(rows, fallback=used), metrics.rouge_l(rows, fallback=used), metrics.toxicity_reduction(rows, fallback=used)]
    parts = []
    for report in reports:
        names = [c for c in report.columns if c not in ("metric", "filter_applied")]
        values = [F.round(F.col(c).cast("double"), 6).alias(c) for c in names]
        parts.append(report.select("metric", *values).unpivot("metric", names, "name", "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- training ---------------------------------------------------------------------------------------------


def _corpus(spark, folder):
    """The corpus as training reads it: written by the preparation job, then scanned."""
    return materialised(corpus.clean_corpus(views.raw_dialogues(spark, folder)), "corpus")


@query
def training_set(spark, folder):
    return jobs.model_input(corpus.training_examples(_corpus(spark, folder)))


@query
def train_valid_split(spark, folder):
    return jobs.training_table(_corpus(spark, folder))


@query
def classify_label(spark, folder):
    rows = jobs.training_table(_corpus(spark, folder))
    model = jobs.fit_classifier(rows.filter("split = 'train'"))
    return jobs.classify(model, rows.select("text", "emotion", "split"))


def _stored_classifier(spark, rows):
    """The path of a classifier fitted on the training split."""
    path = scratch_path(spark, "classifier")
    jobs.save_classifier(jobs.fit_bayes_classifier(rows.filter("split = 'train'")), path)
    return path


@query
def classify_label_bayes(spark, folder):
    """Labels of the whole corpus by a stored model, read back."""
    rows = jobs.training_table(_corpus(spark, folder))
    model = jobs.load_classifier(_stored_classifier(spark, rows))
    return jobs.classify(model, rows.select("text", "emotion", "split"))


@query
def emotion_alignment_predicted(spark, folder):
    """Gold labels of a CSV file of unseen pairs against the labels a stored model predicts."""
    rows = jobs.training_table(_corpus(spark, folder))
    path = scratch_path(spark, "emotion-pairs")
    tables.write_csv(rows.filter("split = 'valid'").select("text", F.col("emotion").alias("reference_emotion")), path)
    model = jobs.load_classifier(_stored_classifier(spark, rows))
    return _rounded(jobs.emotion_report(tables.scan_csv(spark, path, escape='"'), model))


# ---- streams ------------------------------------------------------------------------------------------------


def _turn_files(spark, folder) -> str:
    """Turns and messages as the files a stream reads, some turns twice."""
    path = scratch_path(spark, "turns")
    fields = streams.TURN_SCHEMA.fieldNames()
    turns = views.turns(spark, folder).select(*fields)
    none = F.lit(None).cast("string")
    facts = views.messages(spark, folder).select(
        F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("turn_id"), "user_id",
        none.alias("conversation_id"), "user_message", none.alias("bot_response"), none.alias("emotion"), "created_at",
    )
    repeated = turns.filter(F.col("emotion") == "sad")
    turns.unionByName(facts).unionByName(repeated).repartition(8).write.parquet(path)
    return path


@query
def stream_memory_ingest(spark, folder):
    store, state = memory.memory_store(spark, scratch_path(spark, "memory"), buckets=16), scratch_path(spark, "state")
    turns = streams.read_stream(spark, _turn_files(spark, folder), files_per_batch=3)
    streams.ingest_memory(turns, store, state, merge_over=2).awaitTermination()
    return store.read().select("id", "user_id", "type", "document", _stamp("created_at").alias("created_at"))


@query
def stream_memory_stats(spark, folder):
    store = memory.memory_store(spark, scratch_path(spark, "memory"), buckets=16)
    stats, state = scratch_path(spark, "stats"), scratch_path(spark, "state")
    turns = streams.read_stream(spark, _turn_files(spark, folder), files_per_batch=4)
    streams.ingest_memory(turns, store, state, stats=stats).awaitTermination()
    return streams.latest_stats(spark.read.parquet(stats))


@query
def stream_guard(spark, folder):
    out, state = scratch_path(spark, "guarded"), scratch_path(spark, "state")
    schema = views.table(spark, folder, "documents").schema
    # a pattern, since a stream's path must be a folder and the table may be one file or a folder of files
    docs = streams.read_stream(spark, f"{folder}/document[s].parquet", schema)
    streams.guard_replies(docs, "text", out, state, words=views.TEST_LEXICON).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "toxic", "final_text")


@query
def stream_retrieve(spark, folder):
    out, state = scratch_path(spark, "hits"), scratch_path(spark, "state")
    path = scratch_path(spark, "turns")
    views.turns(spark, folder).select(*streams.TURN_SCHEMA.fieldNames()).repartition(8).write.parquet(path)
    known, index = _memory_store(spark, folder), _index(spark, folder)
    streams.retrieve_for_turns(
        streams.read_stream(spark, path),
        lambda: known,
        lambda: index,
        out,
        state,
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")
