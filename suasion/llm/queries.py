"""Registered queries of the training-data operators: thin digests of each operator's
output with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.llm.repair_sql import REPAIR_SQL
from suasion.llm.shared import ready, written
from suasion.sources.tables import table

REGISTRY: dict[str, tuple[Callable, str | None]] = {}
END_ID = 1


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)
        REGISTRY[key] = (run, sql)
        return run
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_token_files")
def op1_token_files(spark, sf_dir):
    from suasion.llm.token_files import read_token_files, token_files
    manifest, uri = token_files(spark, table(spark, sf_dir, "documents"),
                                tokenizer_file("word_bpe_49k.json"), END_ID, 49_408)
    return read_token_files(manifest, uri).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op2_decontamination", r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
items AS (SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS t
          FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE side = 'i' AND len(w) > 0),
starts AS (SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS t
           FROM w, (SELECT DISTINCT n FROM items), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k) WHERE side = 'd'),
hits AS (SELECT s.r, s.k, s.n, i.item FROM starts s JOIN items i ON s.n = i.n AND s.t = i.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT r, CAST(item AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.r = hit.r LEFT JOIN found ON w.r = found.r WHERE side = 'd'""")
def op2_decontamination(spark, sf_dir):
    from suasion.llm.decontaminate import build_index, contamination, phrase_matches
    index = build_index(table(spark, sf_dir, "documents"))
    found = contamination(index, phrase_matches(index, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op3_bpe")
def op3_bpe(spark, sf_dir):
    import public_tokenizers

    from suasion.llm.bpe import digests
    return digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op6_simhash")
def op6_simhash(spark, sf_dir):
    from suasion.llm.simhash import fingerprint_hex, near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


TOXICITY_THRESHOLD = 0.7


def toxicity_model(spark, sf_dir, docs):
    """Fitted on labelled rows outside the held-out third."""
    from suasion.llm.shared import fold
    from suasion.llm.toxicity import fit
    return fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1), "toxic")


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    from suasion.llm.shared import fold
    from suasion.llm.toxicity import score
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, sf_dir, docs)
    return (docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(model, F.col("text")).alias("score"))
            .select("*", (F.col("score") >= TOXICITY_THRESHOLD).cast("int").alias("predicted")))


@register("op8_line_dedup", r"""
WITH l AS (
  SELECT doc_id, k - 1 AS line, s[k] AS raw, list_filter(regexp_split_to_array(s[k], '\s+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)),
c AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min((doc_id, line)) AS place FROM l WHERE len(w) > 0 GROUP BY 1),
cut AS (SELECT t, place, p, array_to_string(list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, len(w))), ' ') AS v
        FROM c, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) WHERE len(w) >= 5),
near AS (
  SELECT cut.t FROM cut JOIN (SELECT v, p, min(place) AS low FROM cut GROUP BY v, p) g ON cut.v = g.v AND cut.p = g.p WHERE g.low < cut.place
  UNION SELECT cut.t FROM cut JOIN c ON cut.v = c.t WHERE c.place < cut.place
  UNION SELECT c.t FROM cut JOIN c ON cut.v = c.t WHERE cut.place < c.place),
kept AS (
  SELECT l.doc_id, l.line, l.raw FROM l LEFT JOIN c ON array_to_string(l.w, ' ') = c.t LEFT JOIN near ON near.t = c.t
  WHERE len(l.w) = 0 OR (near.t IS NULL AND c.place = (l.doc_id, l.line))),
out AS (SELECT d.doc_id, count(k.line) AS n, coalesce(string_agg(k.raw, chr(10) ORDER BY k.line), '') AS text
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id)
SELECT doc_id, greatest(n, 1) AS n_lines, CAST(length(text) AS BIGINT) AS n_chars_left, sha256(text) AS text_sha256 FROM out""")
def op8_line_dedup(spark, sf_dir):
    """Documents without repeated lines, by their digests: lines left, characters left, sha256 of the text left."""
    from suasion.llm.line_dedup import without_duplicate_lines
    docs = without_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
                       F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


@register("op5_html_text")
def op5_html_text(spark, sf_dir):
    from suasion.llm.html_text import extract, fit
    return extract(table(spark, sf_dir, "pages"), fit(spark))


@register("op10_lz_fingerprint")
def op10_lz_fingerprint(spark, sf_dir):
    from suasion.llm.lz_fingerprint import edited_likeness
    out = edited_likeness(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                      F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@register("op4_quality")
def op4_quality(spark, sf_dir):
    from suasion.llm.quality import THRESHOLD, fit, scored
    from suasion.llm.shared import fold
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return (scored(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


@register("op7_token_counts", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
kept AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
counts AS (
  SELECT source, lang, 'words-1' AS tokenizer_version,
         list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: len(regexp_extract_all(x, '[^ \\t\\n\\r]+')))) AS n_tokens,
         list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: length(x))) + len(list_distinct(string_split(text, chr(10)))) - 1 AS n_chars
  FROM kept
  UNION ALL
  SELECT source, lang, 'letters-1', len(regexp_extract_all(text, '[a-zA-Z]+')), length(text) FROM kept)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM counts GROUP BY ALL""")
def op7_token_counts(spark, sf_dir):
    """Inserts under two tokenizer versions, revised counts (lines repeated inside a document count
    once), deletes of exact copies (the smallest doc_id stays, a null one only without others), and
    two batches sent again.  A document of the rollup is a row by its contents, so rows with null or
    repeated ids are told apart; of rows equal in everything one stays by a revision."""
    from suasion.llm.rollups import changes, commit, compact, totals
    from suasion.session import scratch_path
    root = scratch_path(spark, "rollup")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", "source", "lang")]
    nulls = [F.col(c).isNull() for c in ("doc_id", "source", "lang")]
    docs = rows.select(F.xxhash64(*row, *nulls).alias("doc_id"), F.col("doc_id").alias("id"), "text", "source", "lang")
    words, letters = (F.regexp_count("text", F.lit(p)) for p in (r"[^ \t\n\r]+", "[a-zA-Z]+"))
    commit(spark, root, "001-load", changes(docs, "insert", "words-1", words, F.length("text"))
           .unionByName(changes(docs, "insert", "letters-1", letters, F.length("text"))))
    lines = F.split("text", "\n", -1)
    once = F.array_join(F.array_distinct(lines), "\n")
    repeated = docs.where(F.size(F.array_distinct(lines)) < F.size(lines))
    revised = changes(repeated.withColumn("text", once), "revise", "words-1", words, F.length("text")).distinct()
    commit(spark, root, "002-revise", revised)
    compact(spark, root)
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("doc_id"))
    first = (docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n"))
             .select(F.col("low.doc_id").alias("_id"), F.col("n")))
    copies = docs.join(first, F.col("doc_id") == F.col("_id"), "left_anti")
    twins = docs.join(first.where("n > 1").select("_id"), F.col("doc_id") == F.col("_id"), "left_semi")  # kept, perhaps with equal rows
    zero = F.lit(0)
    gone = changes(copies, "delete", "words-1", zero, zero).unionByName(changes(copies, "delete", "letters-1", zero, zero))
    one = (changes(twins.withColumn("text", once), "revise", "words-1", words, F.length("text"))
           .unionByName(changes(twins, "revise", "letters-1", letters, F.length("text"))))
    gone = gone.unionByName(one).distinct()
    commit(spark, root, "003-delete-copies", gone)
    commit(spark, root, "002-revise", revised)
    commit(spark, root, "003-delete-copies", gone)
    return totals(spark, root)


@register("op11_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id,
             list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
asked AS (SELECT q, item_id, unnest(w) AS term FROM i),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM held, corpus GROUP BY term, n_docs),
scored AS (SELECT q, item_id, held.r, doc_id,
                  CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN d ON d.r = held.r, corpus
           GROUP BY q, item_id, held.r, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY q ORDER BY score DESC, doc_id, r) QUALIFY row_number() OVER best <= 10""")
def op11_lexical_search(spark, sf_dir):
    from suasion.llm.lexical_search import build_index, search
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


CONTROL_TEXT = r"\### Assistant: </turn> ok"


@register("op12_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '<|turn|>' || replace(regexp_replace(replace(role, '\', '\\'), '<(\||\z)', '<\\\1', 'g'), chr(10), '\n') || chr(10)
             || regexp_replace(replace(text, '\', '\\'), '<(\||\z)', '<\\\1', 'g') || '<|/turn|>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""")
def op12_chat_format(spark, sf_dir):
    """All conversations and one of control strings, as messages of one text part, written and read back."""
    from suasion.llm.chat_format import format_chat, read_back, text_part
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return read_back(written(format_chat(rows.unionByName(own).withColumn("parts", text_part(F.col("text")))), "formatted-chats"))


@register("op13_structure_repair", REPAIR_SQL)
def op13_structure_repair(spark, sf_dir):
    from suasion.llm.structure_repair import audits, damaged
    return audits(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
