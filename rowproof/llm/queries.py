"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_prefix, interpolated_ngrams, language_kernel, license_tfidf, merkle_manifest, periodic_runs, pii_transducer, quality_lists, retrieval_packing, simhash_vptree, toxicity_crf, vector_graph, warc_zstd
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.linked(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept", "audited_recall")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieval_packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_kernel.learned(docs.where(~language_kernel.held_out()))
    out = language_kernel.predicted(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", language_kernel.held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_crf.learned(docs, labels.where(~toxicity_crf.held_out()))
    out = toxicity_crf.scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", toxicity_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern()).withColumnRenamed("id", "doc_id")


def op7_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    deep = F.col("doc_id") % 3  # directories of three depths
    path = F.concat_ws("/", "source", F.when(deep > 0, F.col("lang")), F.when(deep > 1, (F.col("doc_id") % 50).cast("string")), F.col("doc_id").cast("string"))
    found = license_tfidf.scanned(docs.select("doc_id", "text", path.alias("path")), "path")
    return found.select("doc_id", "path", "license", "similarity", "basis", "license_from")


def op8_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_transducer.found(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii_transducer.KINDS), "base_sha256", F.col("joined").alias("spans"))


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.read_archives(warc_zstd.archived(table(spark, sf_dir, "pages")))


def op10_quality_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_lists.judged(docs.select("doc_id", "text"), quality_lists.learned(docs, labels))
    return out.select("doc_id", *[F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("failed").alias("base_failed"), "kept")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents, those whose number the contract names with words repeating from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    said = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return rows.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(said).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    said = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    b = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-b["back"]).alias("start"), b["length"].alias("length"), (-b["small"]).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"), F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_interpolated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    found = interpolated_ngrams.scored(table(spark, sf_dir, "documents"), F.coalesce(remainder != 2, F.lit(True)))
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: merkle_manifest.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", upper, upper.lower())))
    made = merkle_manifest.manifest(docs, leaf(F.col("text")), tampered=tampered)
    found = merkle_manifest.proofs(made).withColumn("folded_root", merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    root = F.lit(made.root)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_vector_graph, op2_retrieval_packing, op3_language_kernel, op4_simhash_vptree, op5_toxicity_crf, op6_bpe_prefix, op7_license_tfidf, op8_pii_transducer, op9_warc_zstd, op10_quality_lists, op11_periodic_runs, op12_interpolated_ngrams, op13_merkle_manifest]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
    SELECT * FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
       min(r.b) AS component_id, v.vec_id = min(r.b) AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""

OP9 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT *, list_transform(range(1, 41), lambda k: strpos('0123456789abcdef', substr(h, CAST(k AS BIGINT), 1)) - 1) AS q,
           max(page_id) OVER (PARTITION BY h) AS top
    FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + (((q[5 * i // 4 + 1] * 16 + q[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


def license_sql() -> str:
    """The scan with every unit compared, without triggers."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    some = lambda words: "[" + ", ".join(map(q, words)) + "]::VARCHAR[]"
    texts = ", ".join(f"({i}, {q(t.name)}, {q(t.text)}, {some(t.needs)}, {some(t.bars)})" for i, t in enumerate(license_tfidf.TEMPLATES))
    term = license_tfidf.TERM
    return f"""
WITH tpl(t, name, text, needs, bars) AS (VALUES {texts}),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 > 1 THEN CAST(doc_id % 50 AS VARCHAR) END, CAST(doc_id AS VARCHAR)) AS path
    FROM documents
),
n AS (SELECT count(*) AS n FROM docs),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM docs) GROUP BY term),
tw AS (SELECT t, term, count(*) AS tf FROM (SELECT t, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM tpl) GROUP BY ALL),
tv AS (SELECT t, term, (1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM tw LEFT JOIN df USING (term), n),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tv GROUP BY t),
line AS (
    SELECT r, k, line, regexp_extract_all(lower(line), '{term}') AS terms
    FROM (SELECT r, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT r, string_split(text, chr(10)) AS s FROM docs))
),
known AS (SELECT list(DISTINCT term) AS known FROM tw),
mark AS (SELECT r, k, terms, 2 * len(list_intersect(list_distinct(terms), known)) >= len(list_distinct(terms)) AS good FROM line, known),
run AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS run, sum(CASE WHEN len(terms) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS block FROM mark),
said AS (SELECT r, k, regexp_replace(regexp_extract(line, '{license_tfidf.SPDX}', 1), '[ \t]+', ' ', 'g') AS said FROM line),
unit AS (
    SELECT r, 'file' AS kind, 1 AS rank, NULL AS said, 0 AS k, unnest(terms) AS term FROM line
    UNION ALL SELECT r, 'header', 1, NULL, run, unnest(terms) FROM run WHERE good
    UNION ALL SELECT r, 'paragraph', 1, NULL, block, unnest(terms) FROM run
    UNION ALL SELECT r, 'line', 0, NULL, k, unnest(terms) FROM line
    UNION ALL SELECT r, 'spdx', 2, said, k, 'spdx-license-identifier' FROM said WHERE said <> ''
),
w AS (SELECT r, kind, rank, said, k, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM (SELECT r, kind, rank, said, k, term, count(*) AS tf FROM unit GROUP BY ALL) JOIN df USING (term), n),
un AS (SELECT r, kind, k, sqrt(sum(w * w)) AS norm, list(term) AS terms FROM w GROUP BY ALL),
dot AS (SELECT r, kind, rank, said, k, t, sum(w.w * tv.w) AS dot FROM w JOIN tv USING (term) GROUP BY ALL),
best AS (
    SELECT r, kind, rank, round(dot / (tn.norm * un.norm), 6) AS cos, coalesce(said, name) AS name
    FROM dot JOIN tn USING (t) JOIN un USING (r, kind, k) JOIN tpl USING (t)
    WHERE list_has_all(terms, needs) AND NOT list_has_any(terms, bars)
),
own AS (
    SELECT r, max(struct_pack(rank := rank, cos := cos, name := name)) AS b, bool_or(kind = 'file') AS is_file FROM best WHERE cos >= {license_tfidf.SIMILAR} AND name IS NOT NULL GROUP BY r
),
doc AS (
    SELECT d.*, b.cos, b.name, regexp_replace(path, '/[^/]*$', '') AS dir, coalesce(is_file, FALSE) AS is_file
    FROM docs d LEFT JOIN own USING (r)
),
declared AS (
    SELECT dir AS up, name AS license FROM (SELECT dir, name, count(*) AS n FROM doc WHERE is_file GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, name DESC) = 1
),
above AS (
    SELECT dir, array_to_string(p[1:CAST(k AS BIGINT)], '/') AS up
    FROM (SELECT dir, p, unnest(range(0, len(p) + 1)) AS k FROM (SELECT DISTINCT dir, string_split(dir, '/') AS p FROM doc))
),
near AS (
    SELECT dir, up, license FROM above JOIN declared USING (up)
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1
)
SELECT doc_id, path, coalesce(name, near.license) AS license, cos AS similarity,
       CASE WHEN name IS NOT NULL AND is_file THEN 'file' WHEN name IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN name IS NOT NULL THEN path ELSE near.up END AS license_from
FROM doc LEFT JOIN near USING (dir)
"""


#: CRC-32 of a number's decimal digits, as an expression of {x}.
CRC = """xor(list_reduce(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda a, c: list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(a, c)), 4294967295), 4294967295)"""

OP11 = f"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {CRC.format(x="doc_id")} AS h FROM documents
), size AS (
    SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % len(w) AS a FROM split
), told AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM size
), word AS (
    SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM told
), six AS (
    SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d || ' ' || lead(word, 5) OVER d AS six
    FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
    SELECT * FROM six WHERE six IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, six) > 1
), pair AS (
    SELECT b.doc_id, b.i - a.i AS q, b.i AS s FROM twice a JOIN twice b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i AND 2 * (b.i - a.i) <= a.n
), stretch AS (
    SELECT doc_id, q, min(s) AS s, count(*) + 5 AS m FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, q ORDER BY s) AS island FROM pair) GROUP BY doc_id, q, island
), run AS (
    SELECT doc_id, s - q AS start, m + q AS length, min(q) AS period FROM stretch WHERE m + q >= greatest(12, 2 * q) GROUP BY ALL
), best AS (
    SELECT *, 1000 * length // period AS exponent_milli FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
), said AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN said USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def merkle_sql(levels: int = 8) -> str:
    """Trees of up to 16 ** levels leaves and groups, level by level."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), text]) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(text, '{upper}', '{upper.lower()}')"

    def tree(name: str) -> list[str]:
        """Tables of ``name``0 (tree, r, d): each level's nodes with what stands left and right of them."""
        out = []
        for k in range(levels):
            run = "(PARTITION BY tree, r // 16 ORDER BY r ROWS BETWEEN"
            out.append(f"""{name}s{k} AS (
    SELECT *, m > 1 AS more, CASE WHEN m > 1 THEN coalesce(string_agg(d, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lt,
           CASE WHEN m > 1 THEN coalesce(string_agg(d, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rt
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k})
), {name}{k + 1} AS (
    SELECT tree, r // 16 AS r, CASE WHEN any_value(more) THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d FROM {name}s{k} GROUP BY tree, r // 16
)""")
        return out

    ctes = [f"""leaf AS (
    SELECT doc_id, source, {leaf(field("text"))} AS d, CASE WHEN {CRC.format(x="doc_id")} % 5 = 0 THEN {leaf(field(lower))} END AS t,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM documents
), a0 AS (SELECT tree, r, d FROM leaf)""", *tree("a"), f"b0 AS (SELECT 0 AS tree, tree AS r, d FROM a{levels})", *tree("b")]  # fmt: skip
    ctes.append("f0 AS (SELECT *, coalesce(t, d) AS now, '' AS sibs FROM leaf)")
    at = 0
    for name, rank, own in (("a", "f.r", "f.tree"), ("b", "f.tree", "0")):
        for k in range(levels):
            ctes.append(f"""f{at + 1} AS (
    SELECT f.* EXCLUDE (now, sibs), CASE WHEN s.more THEN sha256(s.lt || f.now || s.rt) ELSE f.now END AS now, f.sibs || s.lt || s.rt AS sibs
    FROM f{at} f JOIN {name}s{k} s ON s.tree = {own} AND s.r = {rank} // {16**k}
)""")
            at += 1
    return "WITH " + ", ".join(ctes) + f"""
SELECT f.doc_id, f.d AS leaf, g.d AS subroot, root.d AS root, sha256(f.sibs) AS proof_sha256, f.now AS folded_root, f.now = root.d AS verified
FROM f{at} f JOIN a{levels} g ON g.tree = f.tree, b{levels} root
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_graph": OP1, "op7_license_tfidf": license_sql(), "op9_warc_zstd": OP9, "op11_periodic_runs": OP11, "op13_merkle_manifest": merkle_sql()}
