"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import ann, centroids, chat, codes, digests, mixing, packing, pii, quality, simhash, substring, toxicity, warc
from pagemill.llm.common import stored, table
from pagemill.session import work_path

#: Production mix: the weights of the sources in turn, and the most copies of a document.
WEIGHTS, MAX_REPEATS = [5.0, 2.0, 1.0], 3


def byte_encoder() -> packing.Encoder:
    """Public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return packing.Encoder(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest vectors, by Euclidean distance, of every row whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near-duplicates of every document: three-word shingles, two bits."""
    groups = simhash.grouped(table(spark, folder, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived and read back: what its record and its full payload say."""
    place = work_path(spark, "archive")
    warc.write(table(spark, folder, "pages"), place, min_revisit_bytes=1000, repeats=True)
    # A response's payload is cut from its rebuilt bytes; a revisit has none of its own.
    own = F.substring("record", F.octet_length("header") + 1, F.octet_length("record"))
    records = warc.read(spark, place).withColumn("body", F.when(F.col("type") == "response", own).otherwise(F.when(
        F.octet_length(own) == 0, F.col("payload")
    ).otherwise(F.raise_error(F.lit("a revisit with a payload")).cast("binary"))))
    records = records.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", F.sha1("body"))
    return records.select("id", "type", "payload_bytes", "payload_digest", "refers_to").toDF(
        "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document by rules learned from ``labels.quality``."""
    result, _ = quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return result.select("doc.doc_id", *counts, "base_failed", "kept", "rule")


def op5_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document and its offending spans (start:end), learned from the labels of three of four ids."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    seen = F.coalesce(remainder != 2, F.lit(True))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, folder, "labels").select("doc_id", "toxic"), seen)
    score, span = F.col("score"), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return found.select("doc.doc_id", "score", "spans").select(
        "doc_id", (~seen).alias("held_out"), "score", (score >= 0.3).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", span), ",").alias("spans"),
    )


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, formatted by their layout and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("completion"))).alias("record")
    )
    made = chat.format_records(chat.layouts_of(table(spark, folder, "conversations")).unionByName(extra), strict=True)
    read = made.withColumn("turns", chat.parsed(F.col("text"))).withColumn("learned", chat.under_loss(F.col("text"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def op7_fm_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that 13-word windows share with a smaller document."""
    found = substring.deduplicated(table(spark, folder, "documents").select("doc_id", "text"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_vector_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1,024 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), byte_encoder())


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes; sources weigh 5, 2, 1 in turn."""
    rows = mixing.rows_of(table(spark, folder, "documents"), ["doc_id"])
    places = stored(mixing.placed(rows, WEIGHTS, MAX_REPEATS), "mix")
    drawn = mixing.dealt(places, block_words=20_000, shard_words=2_000_000).groupBy("row").agg(F.sum("size").alias("taken"))
    found = places.join(drawn, "row", "left").join(rows.select("row", "doc.doc_id"), "row")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and spans the trained field adds."""
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc.doc_id", *[n(kind) for kind in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three rounds of 16 centroids."""
    return centroids.clustered(table(spark, folder, "embeddings"), k=16, rounds=3, scale=64, width=64).drop("compared")


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Which of equal texts stays, by an index of digests that documents reach in two batches."""
    found = digests.deduplicated(table(spark, folder, "documents"), work_path(spark, "index"), batches=2)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen-part code and error of every vector, with 64 entries a part trained in two rounds."""
    made, books = codes.coded(table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return codes.with_label_errors(made).select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_warc_archive": op3_warc_archive,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxic_spans": op5_toxic_spans,
    "op6_chat_format": op6_chat_format,
    "op7_fm_index_dedup": op7_fm_index_dedup,
    "op8_vector_best_fit": op8_vector_best_fit,
    "op9_source_mix": op9_source_mix,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

def _clusters_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and floored means, one after the other."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} as (
            select r, vec_id, v, c, d from (
                select r, vec_id, kept.v, c, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i])))::bigint as d
                from kept, c{n}
            ) qualify row_number() over (partition by r order by d, c) = 1
        )""")
        if n < rounds:
            steps.append(f"""
        m{n} as (
            select c, list(m order by i) as v from (
                select c, i, floor(sum(v[i])::double / count(*))::bigint as m from a{n}, (select unnest(range(1, 65)) as i) group by c, i
            ) group by c
        ),
        c{n + 1} as (select c{n}.c, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} using (c))""")
    return f"""
        with kept as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ),
        c0 as (
            select (row_number() over (order by sha256('1:' || vec_id::varchar), v) - 1)::int as c, v from kept
            qualify c < {k}
        ),{",".join(steps)},
        sums as (select c, sum(d)::bigint as n from a{rounds} group by c)
        select vec_id, a.c as cluster, d as distance, n as cluster_inertia, (select sum(d) from a{rounds})::bigint as inertia,
               sha256(array_to_string(f.v, ',')) as centroid_sha256
        from a{rounds} a join sums using (c) join c{rounds} f using (c)
    """


def _codes_sql(entries: int, rounds: int) -> str:
    """Rounds over the parts of every vector; ``q`` is the part, ``e`` the entry."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} as (
            select r, q, v, e, d from (
                select r, p.q, p.v, e, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b{n}.v[i]) * (p.v[i] - b{n}.v[i])))::bigint as d
                from parts p join b{n} on p.q = b{n}.q
            ) qualify row_number() over (partition by r, q order by d, e) = 1
        )""")
        if n < rounds:
            steps.append(f"""
        m{n} as (
            select q, e, list(m order by i) as v from (
                select q, e, i, floor(sum(v[i])::double / count(*))::bigint as m
                from (select q, e, v, unnest(range(1, len(v) + 1)) as i from a{n}) group by q, e, i
            ) group by q, e
        ),
        b{n + 1} as (select b{n}.q, b{n}.e, coalesce(m{n}.v, b{n}.v) as v from b{n} left join m{n} using (q, e))""")
    return f"""
        with kept as (
            select row_number() over (order by vec_id, embedding) as r, vec_id, label,
                   list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ),
        parts as (select r, q, v[1 + q * (len(v) // 16):(q + 1) * (len(v) // 16)] as v from kept, (select unnest(range(16)) as q)),
        b0 as (select q, (r - 1)::int as e, v from parts where r <= {entries}),{",".join(steps)},
        coded as (
            select r, string_agg(lpad(to_hex(e), 2, '0'), '' order by q) as code, sum(d)::bigint as error from a{rounds} group by r
        ),
        books as (select sha256(string_agg(array_to_string(v, ','), ',' order by q, e)) as codebooks_sha256 from b{rounds})
        select vec_id, lower(code) as code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
        from kept join coded using (r), books
    """


def _escaped_sql(text: str) -> str:
    """SQL of a text with doubled backslashes and every control string broken after its first character."""
    out = f"replace({text}, '\\', '\\\\')"
    for said in chat.CONTROL:
        out = f"replace({out}, '{said}', '{said[0]}\\{said[1:]}')"
    return out


#: DuckDB statements for those that SQL can express.
ORACLES: dict[str, str] = {
    "op3_warc_archive": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        k as (select *, strlen(body) as payload_bytes, max(page_id) over (partition by body) as last from p)
        select page_id, payload_bytes, sha1(body) as payload_digest,
               case when payload_bytes < 1000 or page_id = last then 'response' else 'revisit' end as record_type,
               case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
        from k
    """,
    "op6_chat_format": f"""
        with said as (
            select conv_id, turn, role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        made as (
            select *, length('{chat.START}') + length({_escaped_sql("role")}) + 1 + length({_escaped_sql("text")}) + {len(chat.END)} as n
            from said
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
               sum(n)::bigint as formatted_chars
        from made group by conv_id
    """,
    "op7_fm_index_dedup": r"""
        with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        places as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from split where len(ws) >= 13),
        windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from places),
        firsts as (select k, min(doc_id) as least from windows group by k),
        gone as (
            select distinct doc_id, i + j as p from windows join firsts using (k), (select unnest(range(13)) as j) where least < doc_id
        ),
        words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from split),
        kept as (
            select doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by w.p) filter (g.p is null) as kept
            from words w left join gone g using (doc_id, p) group by doc_id
        )
        select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from split left join kept using (doc_id)
    """,
    "op11_centroid_clusters": _clusters_sql(16, 3),
    "op12_exact_dedup": r"""
        with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from texts
    """,
    "op13_vector_codes": _codes_sql(64, 2),
    "op9_source_mix": r"""
        with sized as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                   md5('0:' || doc_id::varchar) as h
            from documents
        ),
        sources as (
            select source, sum(size)::bigint as source_size,
                   [5.0::double, 2.0, 1.0][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight
            from sized group by source
        ),
        ratios as (select *, (3 * source_size)::double as cap, (3 * source_size)::double / weight as ratio from sources),
        filled as (
            select *, ((sum(source_size) over ())::double
                       - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
                      / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level
            from ratios
        ),
        targets as (
            select source, source_size, least(cap, (max(level) filter (where level <= ratio) over ()) * weight) as target from filled
        ),
        placed as (
            select *, coalesce(sum(size) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) as start
            from sized
        )
        select p.doc_id, p.size::bigint as size, t.source_size, t.target,
               case when p.size = 0 then 0 else
                   p.size * least(3, greatest(0, floor((t.target - p.start - p.size / 2) / t.source_size)::bigint + 1))
               end::bigint as taken
        from placed p join targets t on p.source is not distinct from t.source
    """,
}
