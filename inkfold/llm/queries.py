"""One query per operator, over its whole table; thin digests of what the operators return."""

from __future__ import annotations

import uuid
from zlib import crc32

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_diff, language_id, mixing, periodic_runs, pii, quality_model, quality_rules, simhash, token_counts, toxicity, vector_codes
from .bytewords import texts_as_bytes
from .support import arrow_column, held_out, shared_folder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the fingerprint of a text is kept, so the digest does not carry texts through the shuffle
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.sha2(pii.listed(F.col("pii"), pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", *[count(k) for k in pii.BASE_KINDS], base, pii.listed(F.col("pii")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("lang", "text"))
    return out.select("page_id", "url", "language", "probability", "declared", "addressed")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_replies(chat.as_replies(turns.unionByName(own)))
    turns = chat.read_turns(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        F.col("conv").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: Tree weights of the mixing query and stage; paths that are not named weigh 1.
MIX_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1, "domain0/en": 3, "domain1/en": 2, "domain0/en/src0": 2}
MIX_EPOCHS, MIX_SEED = 3, 7


def source_domain(source: Column) -> Column:
    """Sources are dealt to four domains by their number."""
    number = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    return F.when(number.isNull(), "other").otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, source_domain(F.col("source")), MIX_WEIGHTS, F.expr("tokens div 2"), MIX_EPOCHS, MIX_SEED)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def loop_words(words: list[bytes], h: int) -> list[bytes]:
    """From word ``a`` on, the words repeat with a period that ``h`` sets."""
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@arrow_column("string")
def _looped(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    out = []
    for key, data in zip(doc_id.to_pylist(), texts_as_bytes(text), strict=True):
        h = 1 if key is None else crc32(str(key).encode())
        words = data.split() if h % 10 == 0 else []
        out.append((b" ".join(loop_words(words, h)) if words else data).decode())
    return pa.array(out, pa.string())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", _looped("doc_id", "text").alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, so that a run's work never depends on runs before it."""
    cache = f"{shared_folder(spark)}/inkfold-{spark.sparkContext.applicationId}/token-cache-{uuid.uuid4().hex}"
    tokenizer = token_counts.TokenizerFile.load(public_tokenizers.path("word_bpe_49k.json"))
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def queries() -> dict:
    own = (op1_quality_rules, op2_decontaminate, op3_simhash, op4_quality_model, op5_pii, op6_language_id, op7_chat, op8_mixing, op9_html, op10_toxicity, op11_periodic_runs, op12_vector_codes, op13_token_counts)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_OP1 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w) u),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, sum(least(8, i - coalesce(p, -8))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM twice) z GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '\PL+', '', 'g')) AS letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS capitals,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 10 * letters < 6 * word_chars OR 10 * capitals > 4 * letters OR 5 * stutters > n_words AS bad FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP2 = f"""WITH i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_CUT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (SELECT item, k, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0) u),
d AS (SELECT doc_id, row_number() OVER () AS r, {_CUT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) l WHERE len(w) >= k) u),
hits AS (SELECT r, p, k, item FROM dw JOIN iw USING (k, x)),
places AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) u GROUP BY 1),
found AS (SELECT r, count(DISTINCT item) AS m, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(m, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""

_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\', '')) + length({0}) - length(replace({0}, '#', '')) - len(regexp_extract_all({0}, '#+')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
_OP7 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
  sum(14 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM t"""


def _share(children: str, parent: str, name: str) -> str:
    """SQL that shares each parent's budget among its children, as ``mixing.share_out`` does."""
    w = f"OVER (PARTITION BY {parent} ORDER BY cap / weight, {name}"
    return f"""(SELECT *, CASE WHEN fits THEN cap ELSE (budget - min(CASE WHEN NOT fits THEN spent END) OVER (PARTITION BY {parent})) * weight // max(CASE WHEN NOT fits THEN rest END) OVER (PARTITION BY {parent}) END AS given
  FROM (SELECT *, (budget - spent) * weight >= cap * rest AS fits FROM (SELECT *, CAST(coalesce(sum(cap) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent,
    CAST(sum(weight) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM {children}) a) b)"""


def _weight(path: str) -> str:
    return "CASE " + path + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1 END AS weight"


_OP8 = rf"""WITH s AS (SELECT doc_id, lang, source, coalesce(lang, '(none)') AS g, coalesce(source, '(none)') AS s,
    CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$') THEN 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) ELSE 'other' END AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS base FROM documents),
leaf AS (SELECT d, g, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS cap FROM s GROUP BY 1, 2, 3),
total AS (SELECT CAST(sum(tokens) // 2 AS BIGINT) AS budget FROM leaf),
dom AS (SELECT d, CAST(sum(cap) AS BIGINT) AS cap, 0 AS root, any_value(budget) AS budget, {_weight("d")} FROM leaf, total GROUP BY d),
dom2 AS (SELECT d, given AS budget FROM {_share("dom", "root", "d")} z),
lan AS (SELECT d, g, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget, {_weight("d || '/' || g")} FROM leaf JOIN dom2 USING (d) GROUP BY d, g),
lan2 AS (SELECT d, g, given AS budget FROM {_share("lan", "d", "g")} z),
sou AS (SELECT d, g, s, tokens, cap, budget, {_weight("d || '/' || g || '/' || s")} FROM leaf JOIN lan2 USING (d, g)),
plan AS (SELECT d, g, s, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM {_share("sou", "d, g", "s")} z),
k AS (SELECT s.*, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' || base) AS key FROM s JOIN plan USING (d, g, s) WHERE tokens > 0),
u AS (SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY d, g, s ORDER BY key) <= rest THEN 1 ELSE 0 END AS draws FROM k)
SELECT doc_id, d AS domain, lang, source, tokens, CAST(unnest(range(draws)) AS INT) AS epoch FROM u"""


_COMPONENTS = "list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"


def _vector_sql(entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """The plain method, round by round: all distances, nearest entries, floored means."""
    out = [
        f"v AS (SELECT vec_id, label, {_COMPONENTS} AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS (SELECT vec_id, label, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x FROM v, (SELECT unnest(range(4)) AS p) t)",
        f"c0 AS (SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM x) z WHERE k < {entries})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT vec_id, label, p, any_value(x) AS x, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT vec_id, label, x.p, x, k, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM x JOIN c{r} USING (p)) z GROUP BY vec_id, label, p)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT p, k, list(m ORDER BY j) AS m FROM (SELECT p, k, j, floor(sum(x[j]) / count(*)) AS m FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS j FROM a{r}) u GROUP BY p, k, j) z GROUP BY p, k)")
            out.append(f"c{r + 1} AS (SELECT p, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))")
    out.append(f"f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    out.append(f"s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, s"


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are tested by brute force or held-out labels."""
    return {"op1_quality_rules": _OP1, "op2_decontaminate": _OP2, "op7_chat": _OP7, "op8_mixing": _OP8, "op12_vector_codes": _vector_sql()}
