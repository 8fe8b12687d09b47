"""The corpus operators' registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postora import catalogue
from postora.llm import decontaminate, embeddings, licenses, minhash, mixing, quality, sharding, substring, tokens, warc
from postora.llm.frames import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the share of a text's words that lie in what was found. Nulls, empty and long texts, ties, repeated rows
    and empty tables: as the operator's docstring says."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"]).select("doc_id", "license_found.*")
    share = F.coalesce(F.col("covered") / F.nullif("words", F.lit(0)), F.lit(0.0))
    return found.select("doc_id", F.col("words").alias("n_words"), F.col("base").alias("n_base"), F.col("first").alias("first_word"), F.col("last").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), share.alias("score"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its size, what its source is to have, how much of it the mix takes, and when first. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_takes") * F.col("mix_size")).alias("taken"), F.get("mix_positions", F.lit(0)).alias("first_position"))
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the number of words removed and a digest of those kept. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    found = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("repeat_words").alias("n_words"), F.col("repeat_removed").alias("n_removed"), F.sha2("repeat_kept", 256).alias("kept_sha256"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its number of links and its class. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    found = embeddings.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", F.col("near_links").alias("n_links"), F.col("near_component").alias("component_id"), F.col("near_kept").alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the size of its set and its class. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)
    return found.select("doc_id", F.col("near_shingles").alias("n_shingles"), F.col("near_component").alias("component_id"), F.col("near_kept").alias("kept"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its shard and slot, under the law `key`. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    placed = sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"), sharding.Topology.even(16))
    return placed.select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("shard_slot").cast("long").alias("slot"), F.col("shard_grown").alias("grown_shard"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive of all pages says of each, read back from it. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    folder = shared_folder(spark)
    warc.records(_table(spark, sf_dir, "pages")).write.parquet(folder)
    found = warc.read(spark.read.parquet(folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of each document. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    found = tokens.count(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", F.col("token_count.words").alias("n_words"), F.col("token_count.tokens").alias("n_tokens"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which the document holds a window. Nulls, empty and long texts,
    ties, repeated rows and empty tables: as the operator's docstring says."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", F.explode("leak_found").alias("f")).select("doc_id", F.col("f.item").alias("item_id"), F.col("f.similarity").alias("similarity"), F.col("f.start").alias("first_word"), F.col("f.words").alias("n_words"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its score; rows of the hold-out are never learned from. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as the operator's docstring says."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select("doc_id", quality.in_holdout("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses_sql() -> str:
    """Base phrases by comparing words, templates as regular expressions from where two of their opening words stand."""
    scanner = licenses.compiled(licenses.PHRASES, licenses.TEMPLATES)
    phrases = [([w.decode() for w in words], label) for _, words, label in scanner.phrases]
    lists = ", ".join(f"([{', '.join(map(_quoted, words))}], {_quoted(label)})" for words, label in phrases)
    templates = ", ".join(f"({_quoted(label)}, {_quoted('^' + t.pattern)})" for t, label, _ in scanner.templates)
    openings = ", ".join(sorted({_quoted(" ".join(pair)) for t, _, _ in scanner.templates for pair in t.openings()}))
    most = max(len(t.steps) for t, _, _ in scanner.templates)
    return f"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT doc_id, unnest(list_filter(range(1, len(w) - len(words) + 2), lambda i: w[i : i + len(words) - 1] = words)) AS i, len(words) AS n, label FROM d, (VALUES {lists}) p(words, label)),
        o AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] IN ({openings}))) AS i FROM d),
        a AS (SELECT doc_id, i, label, regexp_extract(array_to_string(w[i : i + {most}], ' ') || ' ', pattern) AS m FROM o, (VALUES {templates}) t(label, pattern)),
        t AS (SELECT DISTINCT doc_id, i, n, label FROM (SELECT doc_id, i, label, len(m) - len(replace(m, ' ', '')) AS n, max(len(m) - len(replace(m, ' ', ''))) OVER (PARTITION BY doc_id, i) AS most FROM a WHERE m <> '') WHERE n = most),
        f AS (SELECT doc_id, i, n, label FROM b UNION ALL SELECT doc_id, i, n, label FROM t),
        c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM b GROUP BY doc_id),
        l AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM f GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(covered / nullif(len(w), 0), 0)::DOUBLE AS score
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""


def _sharding_sql() -> str:
    """The tree of draws, written out: greatest or least draws level by level."""
    tree, key = sharding.Topology.even(16), "'=' || doc_id::VARCHAR"
    draw = lambda path, node: f"(-ln((('0x' || substr(md5('{path}/{node.name}|' || {key}), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / {node.weight}::DOUBLE)"

    def chosen(path: str, nodes: list[sharding.Node]) -> str:
        if nodes[0].shard is not None and len(nodes) == 1:
            return str(nodes[0].shard)
        below = [str(n.shard) if n.shard is not None else chosen(f"{path}/{n.name}", list(n.children)) for n in nodes]
        draws = [draw(path, n) for n in nodes]
        return "CASE " + " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {b}" for d, b in zip(draws, below)) + " END"

    new = tree.grown().regions[-1]
    grown = f"CASE WHEN {draw('', new)} < least({', '.join(draw('', r) for r in tree.regions)}) THEN {new.shards()[0].shard} ELSE shard END"
    return f"""
        WITH d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {catalogue.crc32_sql("coalesce(text, '')")} AS text_crc32, ({chosen("", list(tree.regions))})::INTEGER AS shard FROM documents)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', doc_id::VARCHAR, text_crc32::VARCHAR)), doc_id, size) - 1 AS slot, ({grown})::INTEGER AS grown_shard FROM d"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_embeddings": op4_embeddings,
    "op5_minhash": op5_minhash,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_tokens": op8_tokens,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_licenses": _licenses_sql(),
    "op6_sharding": _sharding_sql(),
    # all windows that share a shingle with an item of their length
    "op9_decontaminate": """
        WITH split AS (SELECT true AS doc, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL SELECT false, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
        i AS (SELECT id AS item_id, w, len(w) AS n, least(5, len(w)) AS g FROM split WHERE NOT doc AND len(w) > 0),
        s AS (SELECT item_id, n, g, array_to_string(w[p : p + g - 1], ' ') AS sh, count(*) AS c FROM (SELECT *, unnest(range(1, n - g + 2)) AS p FROM i) GROUP BY ALL),
        p AS (SELECT id AS doc_id, len(w) AS m, g, p, array_to_string(w[p : p + g - 1], ' ') AS sh FROM (SELECT id, w, g, unnest(range(1, len(w) - g + 2)) AS p FROM split, (SELECT DISTINCT g FROM i) WHERE doc AND len(w) >= g)),
        h AS (SELECT doc_id, m, item_id, n, s.g, p, p.sh, c, least(n, m) AS width FROM p JOIN s ON p.sh = s.sh AND p.g = s.g),
        v AS (SELECT DISTINCT doc_id, item_id, n, g, width, unnest(range(greatest(p + g - width, 1), least(p, m - width + 1) + 1)) AS a FROM h),
        k AS (SELECT v.doc_id, v.item_id, v.n, v.g, v.width, a, sh, least(count(*), c) AS shared FROM v JOIN h ON v.doc_id = h.doc_id AND v.item_id = h.item_id AND h.p BETWEEN a AND a + v.width - v.g GROUP BY v.doc_id, v.item_id, v.n, v.g, v.width, a, sh, c),
        e AS (SELECT doc_id, item_id, width, a, sum(shared)::BIGINT AS hit, (n - g + 1 + width - g + 1 - sum(shared))::BIGINT AS whole FROM k GROUP BY doc_id, item_id, n, g, width, a)
        SELECT doc_id, item_id, max(hit / whole) AS similarity, (arg_max(a, [hit / whole, -a]) - 1)::BIGINT AS first_word, any_value(width)::BIGINT AS n_words FROM e WHERE hit / whole >= 0.8 GROUP BY doc_id, item_id""",
    "op2_mixing": """
        WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
        w AS (SELECT *, [5, 2, 1][kind + 1] AS weight, 3 * source_size AS cap FROM k),
        c AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS top,
            sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS bottom FROM w),
        l AS (SELECT top, bottom FROM c WHERE top * weight <= cap * bottom ORDER BY place LIMIT 1),
        a AS (SELECT source, kind, source_size, CASE WHEN cap * l.bottom < l.top * weight THEN cap::DOUBLE ELSE l.top::DOUBLE * weight::DOUBLE / l.bottom::DOUBLE END AS target FROM w, l),
        p AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.kind, (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
        m AS (SELECT *, before + size / 2 AS middle, (before + size / 2) / target AS y FROM p)
        SELECT doc_id, size, source_size, target, (size * ((middle < target)::BIGINT + (source_size + middle < target)::BIGINT + (2 * source_size + middle < target)::BIGINT))::BIGINT AS taken,
            CASE WHEN middle < target THEN CASE kind WHEN 0 THEN least(2 * y / (sqrt(1.5625::DOUBLE - y) + 1.25::DOUBLE), 1) WHEN 1 THEN least(2 * y / (sqrt(1::DOUBLE) + 1), 1)
                ELSE CASE WHEN y < 0.375::DOUBLE THEN least(2 * y / (sqrt(0.25::DOUBLE + y * 2) + 0.5::DOUBLE), 0.5::DOUBLE) ELSE least(0.5::DOUBLE + 2 * (y - 0.375::DOUBLE) / (sqrt(1::DOUBLE + (y - 0.375::DOUBLE) * 2) + 1), 1) END END END::DOUBLE AS first_position
        FROM m""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        n AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
        FROM n""",
    "op4_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
        r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
        m AS (SELECT node, min(reach) AS least FROM r GROUP BY node),
        c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m.least, v.vec_id) AS component_id, coalesce(m.least, v.vec_id) = v.vec_id AS kept
        FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN m ON m.node = v.vec_id""",
    "op5_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT sh, doc_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, sh) AS place, c.n FROM s JOIN c USING (doc_id) JOIN (SELECT sh, count(*) AS df FROM s GROUP BY sh) USING (sh)) WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1),
        q AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.sh = y.sh AND x.doc_id > y.doc_id),
        e AS (SELECT a, b FROM (SELECT a, b, count(*) AS shared FROM q JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.sh = y.sh GROUP BY a, b) JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
        m AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, coalesce(m.least, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id""",
    "op3_substring": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
        n AS (SELECT doc_id, s, count(*) OVER (PARTITION BY array_to_string(w[s : s + 34], ' ')) AS c FROM p),
        x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM n WHERE c > 1),
        r AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
        k AS (SELECT doc_id, i, w[i] AS word, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.i = x.i GROUP BY k.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id""",
}
