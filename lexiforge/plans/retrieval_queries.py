"""Queries over the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import analysis as A
from lexiforge.operators import retrieval as R

QUERY = "of the nding reading and ering"
TERMS = ["of", "the", "nding", "reading", "and", "ering"]


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_INDEXES: dict[tuple[str, str], R.LexicalIndex] = {}


def index_of(spark, sf_dir) -> R.LexicalIndex:
    """The stored index of sf_dir's documents; built and stored at the application's first use of them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = R.build_index(docs(spark, sf_dir))
    return _INDEXES[key]


def vecs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


_cut = lambda names: f"coalesce(left(t, length(t) - length(list_filter([{', '.join(repr(s) for s in names)}], lambda s: suffix(t, s) and length(t) - length(s) >= 3)[1])), t)"
STEM = f"case when regexp_matches(t, '^[a-z]') then {_cut(A.EN_SUFFIXES)} else {_cut(A.RU_SUFFIXES)} end"
TOK = "regexp_extract_all(text, '[A-Za-zА-Яа-яЁё0-9]+')"
TF = f"raw as (select doc_id, lower(unnest({TOK})) t from documents), tf as (select doc_id, {STEM} term, count(*) tf from raw group by all), n as (select count(*) n_docs, avg(len({TOK})) avgdl from documents), df as (select term, count(*) df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf from tf, n group by term), dl as (select doc_id, len({TOK}) dl from documents)"
QT = f"q as (select distinct {STEM} term from (select lower(unnest({TERMS})) t))"
BM = "bm as (select doc_id, sum(idf * tf * 2.6 / (tf + 1.6 * (1 - 0.68 + 0.68 * dl / avgdl))) s from tf join q using (term) join df using (term) join dl using (doc_id), n group by doc_id)"
COS = "w as (select doc_id, term, (1 + ln(1 + tf)) * idf w from tf join df using (term)), dn as (select doc_id, sqrt(sum(w * w)) dn from w group by 1), qw as (select term, (1 + ln(1 + count(*))) * any_value(idf) wq from (select STEM term from (select lower(unnest(TERMS)) t)) join df using (term) group by term), qn as (select sqrt(sum(wq * wq)) qn from qw), co as (select doc_id, sum(w * wq) / (any_value(dn) * any_value(qn)) c from w join qw using (term) join dn using (doc_id), qn group by doc_id)".replace("STEM", STEM).replace("TERMS", str(TERMS))
FIRST = "trim(split_part(trim(text, ' \n\t\r'), chr(10), 1), ' \n\t\r')"
HEAD = f"case when (length({FIRST}) <= 120 and length({FIRST}) - length(regexp_replace({FIRST}, '\\p{{Lu}}', '', 'g')) >= greatest(1, length({FIRST}) // 5)) or starts_with({FIRST}, '#') then {FIRST} else '' end"
NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
BOOST = f"bo as (select doc_id, case when contains(lower({NORM}), '{QUERY}') then 8.0 else 0.0 end + case when exists (select 1 from (select lower(unnest(regexp_extract_all({HEAD}, '[A-Za-zА-Яа-яЁё0-9]+'))) t) where {STEM} in (select term from q)) then 1.25 else 0.0 end b from documents)"
L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"
DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double))"


def _top(df, k=10, name="score"):
    return df.select("doc_id", F.round(name, 4).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def tokenize_count(s, d):
    return docs(s, d).select("doc_id", F.size(A.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def stem_vocab(s, d):
    words = docs(s, d).select(F.explode(A.tokens(F.col("text"))).alias("t")).select(F.lower("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select("token", A.stem(F.col("token")).alias("stem"), "n")


def term_freq(s, d):
    return R.term_frequencies(docs(s, d)).select("doc_id", "term", "tf")


def doc_freq_idf(s, d):
    x = docs(s, d)
    return R.document_frequencies(R.term_frequencies(x), R.corpus_stats(x)).select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(s, d):
    return R.corpus_stats(docs(s, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def tfidf_norms(s, d):
    return index_of(s, d).doc_stats.select("doc_id", F.round("norm", 5).alias("norm"))


def bm25_topk(s, d):
    return _top(R.scores(index_of(s, d), R.query_terms(s, QUERY)), name="bm25")


def bm25_legacy_topk(s, d):
    return _top(R.bm25(docs(s, d), R.query_terms(s, QUERY + " the", True), 1.5, 0.75, True))


def tfidf_cosine_topk(s, d):
    return _top(R.cosine(index_of(s, d), R.query_terms(s, QUERY)))


def phrase_boost(s, d):
    return docs(s, d).select("doc_id", R.phrase_boost(F.col("text"), " And the ", 8.0).alias("boost"))


def heading_boost(s, d):
    return docs(s, d).select("doc_id", A.heading(F.col("text")).alias("heading"), R.heading_boost(F.col("text"), R.query_terms(s, QUERY), 1.25).alias("boost"))


def hybrid_search(s, d):
    return R.hybrid_search(docs(s, d), QUERY, index=index_of(s, d)).select("doc_id", "score")


def search_highlights(s, d):
    hits = R.hybrid_search(docs(s, d), QUERY, index=index_of(s, d))
    words = s.range(1).select(A.tokens(F.lit(QUERY)).alias("t")).first()["t"]
    return hits.select("doc_id", "score", R.highlights(F.col("text"), words).alias("highlights"))


def fuse_scores(s, d):
    both = R.scores(index_of(s, d), R.query_terms(s, QUERY)).withColumnRenamed("bm25", "bm")
    return R.fused(both).select("doc_id", F.round("score", 5).alias("score"))


def _pool(s, d, scored, k=48):
    """The best k of scored (doc_id, score) as one array in order, with their words."""
    pool = scored.orderBy(F.col("score").desc(), "doc_id").limit(k)
    items = docs(s, d).select("doc_id", "text").join(F.broadcast(pool), "doc_id").select("doc_id", "score", F.array_distinct(A.tokens_legacy(F.col("text"))).alias("words"))
    item = F.struct((-F.col("score")).alias("o"), F.col("doc_id").alias("id"), "score", "words")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda t: F.struct(t["id"].alias("id"), t["score"].alias("score"), t["words"].alias("words")))
    return items.agg(ordered.alias("pool"))


def mmr_select(s, d):
    scored = R.scores(index_of(s, d), R.query_terms(s, QUERY)).select("doc_id", F.round("bm25", 4).alias("score"))
    return _pool(s, d, scored).select(F.posexplode(R.mmr(F.col("pool"))).alias("rank", "doc_id"))


def section_boost(s, d):
    rows = s.createDataFrame([(1, [5, 6, 7], [1, 2, 3], [1, 2]), (2, [1, 6], [1, 2], [1, 2]), (3, [9], [4, 5, 6], [4, 5])], "id int, chosen array<int>, section array<int>, firsts array<int>")
    return rows.select("id", F.concat_ws(",", R.with_section(F.col("chosen"), F.col("section"), F.col("firsts")).cast("array<string>")).alias("ids"))


SECTIONS = [("payment", ["price", "fee"], ["invoice", "advance"]), ("term", ["duration"], ["notice", "invoice"]), ("liability", ["penalty"], ["fine"])]


def query_expand(s, d):
    rows = s.createDataFrame([(1, "What is the  PRICE?"), (2, "term and fee"), (3, "nothing")], "id int, q string")
    return rows.withColumn("x", R.expanded_query(F.col("q"), SECTIONS)).select("id", "x.expanded", "x.target")


def _queries(v):
    return v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn_l2(s, d):
    v = vecs(s, d)
    return R.knn(v, _queries(v), 6).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_cosine(s, d):
    v = vecs(s, d)
    return R.knn(v, _queries(v), 6, "cosine").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_label_vote(s, d):
    v = vecs(s, d)
    near = R.knn(v, _queries(v), 7).filter("query_id <> vec_id").join(v.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x"))
    return best.select("query_id", "x.label", (-F.col("x.n")).alias("votes"))


def l2_normalize(s, d):
    u = R.l2_normalized(F.transform(F.col("embedding"), lambda x: x * F.lit(3.0).cast("float")))
    return vecs(s, d).select("vec_id", F.round(F.get(u, F.lit(0)), 5).alias("first"), F.round(R.dot(u, u), 5).alias("square"))


def valid_vectors(s, d):
    return vecs(s, d).filter(R.valid_vector(F.col("embedding"))).select("vec_id", F.size("embedding").cast("long").alias("dim"))


#: What QUERY's words are about, for the chain: a section's name, other names, and its words.
TOPICS = [("reading", ["nding"], ["ering", "thing"]), ("other", ["never named"], ["zzz"])]


def hybrid_chain(s, d):
    """The query is expanded (R12); vector search with hashed embeddings (R15) and BM25 (R8) give a pool of 48, fused (R9), made
    diverse (R10); at last two documents of the target section come first unless one of it was chosen (R11)."""
    from uuid import uuid4

    from lexiforge.operators.providers import embedded, hashed_embedding
    from lexiforge.sources.store import shared_dir, stored

    x = docs(s, d)
    expanded = s.range(1).select(R.expanded_query(F.lit(QUERY), TOPICS).alias("x")).first()["x"]
    lexical = R.bm25(x, R.query_terms(s, expanded["expanded"], True), 1.5, 0.75, True).withColumnRenamed("score", "bm")
    vectors = embedded(x.select(F.col("doc_id").alias("chunk_id"), "text")).select(F.col("chunk_id").alias("vec_id"), "embedding").filter(R.norm(F.col("embedding")) > 0)
    vectors = stored(vectors, f"{shared_dir(s)}/hashed-{uuid4().hex}")  # read more than once below
    asked = s.createDataFrame([(0, hashed_embedding(expanded["expanded"]))], "query_id long, q array<float>")
    near = R.knn(vectors, asked, 48, "cosine").select(F.col("vec_id").alias("doc_id"), F.col("score").alias("cos"))
    both = near.join(lexical, "doc_id", "left").fillna(0.0, ["bm"])
    chosen = _pool(s, d, R.fused(both)).select(R.mmr(F.col("pool"), 6).alias("ids"))
    target = x.filter(F.contains(F.lower("text"), F.lit(expanded["target"] or "\0"))).select("doc_id")
    firsts = target.orderBy("doc_id").limit(2).agg(F.array_sort(F.collect_list("doc_id")).alias("firsts"))
    mine = target.join(F.broadcast(chosen.select(F.explode("ids").alias("doc_id"))), "doc_id").agg(F.collect_list("doc_id").alias("section"))
    return chosen.crossJoin(F.broadcast(firsts)).crossJoin(F.broadcast(mine)).select(F.posexplode(R.with_section(F.col("ids"), F.col("section"), F.col("firsts"))).alias("rank", "doc_id"))


def _benchmark(s, d):
    return s.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")


def batched_bm25_topk(s, d):
    """Every benchmark text as a query, against all documents: the best five of each."""
    return R.batched_hybrid(index_of(s, d), _benchmark(s, d), w=R.Weights(alpha=1.0, phrase=0.0, heading=0.0))


def batched_hybrid_topk(s, d):
    """R6 with every benchmark text as a query."""
    return R.batched_hybrid(index_of(s, d), _benchmark(s, d))


CATALOGUE = {
    "tokenize_count": (tokenize_count, f"select doc_id, len({TOK}) n_tokens from documents"),
    "stem_vocab": (stem_vocab, f"with r as (select lower(unnest({TOK})) t from documents) select t as token, {STEM} stem, count(*) n from r group by t"),
    "term_freq": (term_freq, f"with {TF} select doc_id, term, tf from tf"),
    "doc_freq_idf": (doc_freq_idf, f"with {TF} select term, df, round(idf, 6) idf from df"),
    "corpus_stats": (corpus_stats, f"select count(*) n_docs, round(avg(len({TOK})), 6) avgdl from documents"),
    "tfidf_norms": (tfidf_norms, f"with {TF} select d.doc_id, round(coalesce(sqrt(sum(power((1 + ln(1 + tf)) * idf, 2))), 1.0), 5) norm from documents d left join tf using (doc_id) left join df using (term) group by d.doc_id"),
    "bm25_topk": (bm25_topk, f"with {TF}, {QT}, {BM} select doc_id, round(s, 4) score from bm order by score desc, doc_id limit 10"),
    "bm25_legacy_topk": (
        bm25_legacy_topk,
        f"with r as (select doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9_]+')) term from documents), tf as (select doc_id, term, count(*) tf from r group by all), dl as (select doc_id, len(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9_]+')) dl from documents), n as (select count(*) n, greatest(avg(dl), 1) a from dl), df as (select term, count(*) df from tf group by 1), q as (select unnest({TERMS + ['the']}) term) select doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 4) score from q join tf using (term) join df using (term) join dl using (doc_id), n group by doc_id order by score desc, doc_id limit 10",
    ),
    "tfidf_cosine_topk": (tfidf_cosine_topk, f"with {TF}, {COS} select doc_id, round(c, 4) score from co order by score desc, doc_id limit 10"),
    "phrase_boost": (phrase_boost, f"select doc_id, case when contains(lower({NORM}), 'and the') then 8.0::double else 0.0::double end boost from documents"),
    "heading_boost": (heading_boost, f"with {QT}, h as (select doc_id, {HEAD} heading from documents) select doc_id, heading, case when exists (select 1 from (select lower(unnest(regexp_extract_all(heading, '[A-Za-zА-Яа-яЁё0-9]+'))) t) where {STEM} in (select term from q)) then 1.25::double else 0.0::double end boost from h"),
    "hybrid_search": (hybrid_search, f"with {TF}, {QT}, {BM}, {COS}, {BOOST} select doc_id, round(0.7 * coalesce(s, 0) + (1 - 0.7) * 100 * coalesce(c, 0) + b, 4)::double score from bo left join bm using (doc_id) left join co using (doc_id) order by score desc, doc_id limit 5"),
    "search_highlights": (search_highlights, None),
    "fuse_scores": (fuse_scores, f"with {TF}, {QT}, {BM}, {COS}, m as (select max(c) cm, max(s) sm from co join bm using (doc_id)) select doc_id, round(0.65 * c / cm + 0.35 * s / sm, 5) score from co join bm using (doc_id), m"),
    "mmr_select": (mmr_select, None),
    "hybrid_chain": (hybrid_chain, None),
    "batched_bm25_topk": (
        batched_bm25_topk,
        f"with {TF}, b as (select item_id, lower(unnest({TOK})) t from benchmark), q as (select distinct item_id, {STEM} term from b), sc as (select item_id, doc_id, round(sum(idf * tf * 2.6 / (tf + 1.6 * (1 - 0.68 + 0.68 * dl / avgdl))), 4) score from q join df using (term) join tf using (term) join dl using (doc_id), n group by all) select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank from sc qualify rank <= 5",
    ),
    "batched_hybrid_topk": (
        batched_hybrid_topk,
        f"with {TF}, b as (select item_id, lower(unnest({TOK})) t from benchmark), q as (select item_id, {STEM} term, count(*) qf from b group by all), qw as (select item_id, term, idf, (1 + ln(1 + qf)) * idf wq from q join df using (term)), qn as (select item_id, sqrt(sum(wq * wq)) qn from qw group by 1), dn as (select doc_id, sqrt(sum(power((1 + ln(1 + tf)) * idf, 2))) dn from tf join df using (term) group by 1), sc as (select item_id, doc_id, sum(idf * tf * 2.6 / (tf + 1.6 * (1 - 0.68 + 0.68 * dl / avgdl))) s, sum(wq * (1 + ln(1 + tf)) * idf) dot from qw join tf using (term) join dl using (doc_id), n group by all), hd as (select doc_id, {HEAD} heading from (select doc_id, {NORM} as text from documents)), ht as (select distinct doc_id, {STEM} term from (select doc_id, lower(unnest(regexp_extract_all(heading, '[A-Za-zА-Яа-яЁё0-9]+'))) t from hd)), hb as (select distinct q.item_id, ht.doc_id, 1.25::double h from q join ht using (term)), bq as (select item_id, lower({NORM}) phrase from benchmark), dt as (select doc_id, lower({NORM}) low from documents), pb as (select item_id, doc_id, 8.0::double p from bq, dt where contains(low, phrase)), al as (select item_id, doc_id, round(0.7 * s + (1 - 0.7) * 100 * dot / (qn * dn) + coalesce(p, 0) + coalesce(h, 0), 4) score from sc join qn using (item_id) join dn using (doc_id) left join pb using (item_id, doc_id) left join hb using (item_id, doc_id)) select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank from al qualify rank <= 5",
    ),
    "section_boost": (section_boost, "select * from (values (1, '1,2,5'), (2, '1,6'), (3, '4,5')) t(id, ids)"),
    "query_expand": (query_expand, "select * from (values (1, 'What is the  PRICE? || payment || price || fee || invoice || advance', 'payment'), (2, 'term and fee || payment || price || fee || invoice || advance || term || duration || notice', 'payment'), (3, 'nothing', null)) t(id, expanded, target)"),
    "knn_l2": (knn_l2, f"with s as (select q.vec_id query_id, e.vec_id, {L2} s from embeddings e, embeddings q where q.vec_id % 50 = 0) select query_id, vec_id, round(s, 6) score, cast(row_number() over (partition by query_id order by s, vec_id) as int) rank from s qualify rank <= 6"),
    "knn_cosine": (knn_cosine, f"with s as (select q.vec_id query_id, e.vec_id, {DOT} / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double)))) s from embeddings e, embeddings q where q.vec_id % 50 = 0) select query_id, vec_id, round(s, 6) score, cast(row_number() over (partition by query_id order by s desc, vec_id) as int) rank from s qualify rank <= 6"),
    "knn_label_vote": (knn_label_vote, f"with s as (select q.vec_id query_id, e.vec_id, e.label, row_number() over (partition by q.vec_id order by {L2}, e.vec_id) rank from embeddings e, embeddings q where q.vec_id % 50 = 0 qualify rank <= 7), v as (select query_id, label, count(*) votes from s where query_id <> vec_id group by all) select query_id, label, votes from v qualify row_number() over (partition by query_id order by votes desc, label) = 1"),
    "l2_normalize": (l2_normalize, "with u as (select vec_id, embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) f from embeddings) select vec_id, round(f, 5) first, 1.0::double square from u"),
    "valid_vectors": (valid_vectors, "select vec_id, len(embedding) dim from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0"),
}
