"""The registered queries of the corpus operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, media, merkle, minhash, mixing, pii, quality, secret_scan, tokens, toxicity, warc, whitening
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.8).drop("row")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"), 32)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), merkle.every_fifth())


def _merkle_field(column: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _merkle_levels(name: str, leaves: str) -> str:
    """The levels of the trees over `leaves` (tree, pos, size, node) as the recursive table `name`, with what stands beside each node as `name`_beside."""
    run = "PARTITION BY level, tree, pos // 16 ORDER BY pos ROWS BETWEEN"
    return f"""
        {name} AS (SELECT 0 AS level, tree, CAST(pos AS BIGINT) AS pos, CAST(size AS BIGINT) AS size, node FROM {leaves}
            UNION ALL SELECT any_value(level) + 1, tree, pos // 16, (any_value(size) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE size > 1 GROUP BY tree, pos // 16),
        {name}_beside AS (SELECT level, tree, pos, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name} WHERE size > 1)"""


def _merkle_fold(name: str, start: str, beside: str) -> str:
    """Each row of `start` (row, tree, pos, now, proof) taken up its tree, level by level, as the recursive table `name`."""
    return f"""
        {name} AS (SELECT 0 AS level, row, tree, CAST(pos AS BIGINT) AS pos, now, proof FROM {start}
            UNION ALL SELECT f.level + 1, f.row, f.tree, f.pos // 16, sha256(b.l || f.now || b.r), f.proof || b.l || b.r FROM {name} f JOIN {beside} b ON f.level = b.level AND f.tree = b.tree AND f.pos = b.pos),
        {name}_end AS (SELECT row, any_value(tree) AS tree, arg_max(now, level) AS now, arg_max(proof, level) AS proof FROM {name} GROUP BY row)"""


#: CRC-32 of doc_id's digits, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_minhash, op4_warc, op5_media_columns, op6_decontamination, op7_pii, op8_mixing, op9_token_counts, op10_secrets, op11_whitening, op12_quality, op13_merkle)}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
        k AS (SELECT r, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
        bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
        kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM bad) GROUP BY r)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op3_minhash": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * c >= 80 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
        least AS (SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON reach.b = o.r GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least USING (r) LEFT JOIN n USING (r)
    """,
    "op4_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT hex, min(page_id) AS least FROM p GROUP BY hex),
        digits AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4)) & 31 AS INTEGER), 1), '' ORDER BY i) AS payload_digest
                   FROM f, (SELECT unnest(range(0, 32)) AS i) GROUP BY hex)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
        FROM p JOIN f USING (hex) JOIN digits USING (hex)
    """,
    "op6_decontamination": rf"""
        WITH source AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
        pieces AS (SELECT side, r, id, regexp_extract_all(t, '([^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]*)([A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+)', 1) AS gaps, regexp_extract_all(t, '([^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]*)([A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+)', 2) AS words FROM source),
        word AS (SELECT side, r, id, unnest(gaps) AS gap, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM pieces),
        low AS (SELECT *, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM word),
        kind AS (SELECT *, CASE WHEN regexp_matches(word, '^[0-9]') OR low IN ({", ".join(f"'{w}'" for w in sorted(decontamination.NUMBERS))}) THEN 1 WHEN low IN ({", ".join(f"'{w}'" for w in sorted(decontamination.UNITS))}) THEN 2 ELSE 0 END AS kind,
                 regexp_full_match(word, '[A-Z][a-z]+') AS capital, i > 1 AND NOT regexp_matches(gap, '[.!?:\n\r]') AS inside FROM low),
        name AS (SELECT DISTINCT side, r, low FROM kind WHERE kind = 0 AND capital AND inside),
        near AS (SELECT DISTINCT a.side, a.r, a.i FROM kind a JOIN kind b ON a.side = b.side AND a.r = b.r AND a.low = b.low AND b.kind = 0 AND b.capital AND b.inside AND abs(a.i - b.i) <= {decontamination.LOCAL} WHERE a.kind = 0 AND a.capital),
        typed AS (SELECT kind.side, kind.r, id, kind.i, kind.low, kind.kind AS plain, CASE WHEN kind = 0 AND capital AND name.low IS NOT NULL THEN 3 ELSE kind END AS everywhere,
                  CASE WHEN kind = 0 AND capital AND inside THEN 3 ELSE kind END AS here, CASE WHEN near.i IS NOT NULL THEN 3 ELSE kind END AS local
                  FROM kind LEFT JOIN name ON kind.side = name.side AND kind.r = name.r AND kind.low = name.low LEFT JOIN near ON kind.side = near.side AND kind.r = near.r AND kind.i = near.i),
        ways AS (SELECT side, r, id, i, low, everywhere AS kind, 0 AS way FROM typed
                 UNION ALL SELECT side, r, id, i, low, plain, 1 FROM typed SEMI JOIN name USING (side, r)
                 UNION ALL SELECT side, r, id, i, low, here, 2 FROM typed SEMI JOIN name USING (side, r)
                 UNION ALL SELECT side, r, id, i, low, local, 3 FROM typed SEMI JOIN name USING (side, r)),
        edge AS (SELECT *, CASE WHEN kind IN (1, 3) AND kind = lag(kind) OVER (PARTITION BY side, r, way ORDER BY i) THEN 0 ELSE 1 END AS opens FROM ways),
        grouped AS (SELECT *, sum(opens) OVER (PARTITION BY side, r, way ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM edge),
        token AS (SELECT side, r, id, way, g, any_value(kind) AS kind, string_agg(low, ' ' ORDER BY i) AS value FROM grouped GROUP BY ALL),
        text AS (SELECT side, r, id, way, count(*) AS n, list(kind ORDER BY g) AS kinds, list(value ORDER BY g) AS vals, list(CASE WHEN kind = 0 THEN value ELSE '<' || kind || '>' END ORDER BY g) AS template FROM token GROUP BY ALL),
        place AS (SELECT *, unnest(range(1, greatest(n - 4, 1) + 1)) AS p FROM text),
        long_win AS (SELECT side, r, id, way, p, count(*) OVER (PARTITION BY side, r, way) AS total, array_to_string(template[p:p + 4], ' ') AS w, kinds[p:p + 4] AS kinds, vals[p:p + 4] AS vals, p = 1 AS first, p + 4 >= n AS last FROM place WHERE list_contains(kinds[p:p + 4], 0)),
        raw AS (SELECT w.side, w.r, w.id, w.way, any_value(t.n) AS n, list(kind ORDER BY i) AS kinds, list(low ORDER BY i) AS vals, list(CASE WHEN kind = 0 THEN low ELSE '<' || kind || '>' END ORDER BY i) AS template FROM ways w JOIN text t USING (side, r, way) GROUP BY ALL),
        short_item AS (SELECT side, r, id, way + 10 AS way, 1 AS p, 1 AS total, array_to_string(template, ' ') AS w, kinds, vals, false AS first, false AS last, len(kinds) AS length FROM raw WHERE side = 'i' AND n < 5 AND list_contains(kinds, 0) AND len(kinds) >= {decontamination.LEAST}),
        short_place AS (SELECT raw.*, length, unnest(range(1, len(kinds) - length + 2)) AS p FROM raw, (SELECT DISTINCT length FROM short_item) WHERE side = 'd' AND len(kinds) >= length),
        short_doc AS (SELECT side, r, id, way + 10 AS way, p, 1 AS total, array_to_string(template[p:p + length - 1], ' ') AS w, kinds[p:p + length - 1] AS kinds, vals[p:p + length - 1] AS vals, false AS first, false AS last, length FROM short_place),
        win AS (SELECT *, 0 AS length FROM long_win UNION ALL SELECT * FROM short_item UNION ALL SELECT * FROM short_doc),
        met AS (SELECT d.r AS d, d.id AS doc_id, i.r AS i, i.id AS item_id, i.total, d.way AS way, i.way AS item_way, d.p - i.p AS diagonal, i.p AS p,
                list_filter(list_zip(range(len(i.kinds)), i.kinds, i.vals, d.vals), lambda z: z[2] != 0 AND NOT (i.first AND z[1] = 0 AND z[2] != 2) AND NOT (i.last AND z[1] = len(i.kinds) - 1 AND z[2] != 2)) AS bound
                FROM win d JOIN win i ON d.side = 'd' AND i.side = 'i' AND d.w = i.w AND d.length = i.length),
        slot AS (SELECT d, i, way, item_way, diagonal, p, unnest(bound) AS b FROM met),
        binding AS (SELECT d, i, way, item_way, diagonal, b[2] AS kind, b[3] AS old, b[4] AS new, count(DISTINCT p) AS n, min(p + b[1]) AS first FROM slot GROUP BY ALL),
        holds AS (SELECT d, i, way, item_way, diagonal, kind, old, arg_max(new, (n, old = new, -first)) AS new FROM binding GROUP BY ALL),
        odd AS (SELECT DISTINCT s.d, s.i, s.way, s.item_way, s.diagonal, s.p FROM slot s JOIN holds h ON s.d = h.d AND s.i = h.i AND s.way = h.way AND s.item_way = h.item_way AND s.diagonal = h.diagonal AND s.b[2] = h.kind AND s.b[3] = h.old AND s.b[4] != h.new),
        good AS (SELECT * FROM met ANTI JOIN odd USING (d, i, way, item_way, diagonal, p)),
        bindings AS (SELECT d, i, item_way, count(DISTINCT b) AS n_slots, count(DISTINCT b) FILTER (b[2] != b[3]) AS n_changed FROM (SELECT d, i, item_way, unnest(list_transform(bound, lambda z: (z[2], z[3], z[4]))) AS b FROM good) GROUP BY ALL),
        found AS (SELECT d, doc_id, i, item_id, item_way, total, count(DISTINCT p) AS n_found FROM good GROUP BY ALL HAVING count(DISTINCT p) >= 0.8 * total),
        best AS (SELECT *, row_number() OVER (PARTITION BY d, i ORDER BY n_found / total DESC, item_way) AS place FROM found LEFT JOIN bindings USING (d, i, item_way))
        SELECT doc_id, item_id, CAST(total AS INTEGER) AS n_windows, n_found, n_found / total AS coverage, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM best WHERE place = 1
    """,
    "op8_mixing": r"""
        WITH h AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256(coalesce(text, '')) AS words FROM documents),
        d AS (SELECT *, sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (row_number() OVER (PARTITION BY doc_id, source, words) - 1) || ':' || words) AS digest FROM h),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        p AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
        w AS (SELECT *, CASE place % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM p),
        f AS (SELECT *, row_number() OVER fill AS n,
                (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2.0::DOUBLE * (sum(source_size) OVER fill - source_size))
                / (sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
              FROM w WINDOW fill AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        t AS (SELECT source, source_size, weight, coalesce(least(2.0::DOUBLE * source_size, weight * (SELECT arg_min(level, n) FROM f WHERE level * weight <= 2.0::DOUBLE * source_size)), 2.0::DOUBLE * source_size) AS target FROM f),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
        q AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, printf('%08x', CAST(floor((rate - floor(rate)) * 4294967296.0) AS BIGINT)) AS bound FROM r),
        c AS (SELECT d.*, q.source_size, q.target, draw, q.whole + CASE WHEN substr(digest, 1 + 8 * draw, 8) < bound THEN 1 ELSE 0 END AS copies
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, (SELECT unnest(range(0, 8))::INTEGER AS draw)),
        b AS (SELECT source, draw, abs(sum(size * copies) - any_value(target)) AS err FROM c GROUP BY source, draw),
        best AS (SELECT source, arg_min(draw, (err, draw)) AS draw FROM b GROUP BY source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken
        FROM c JOIN best ON c.draw = best.draw AND c.source IS NOT DISTINCT FROM best.source
    """,
    "op13_merkle": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, *, coalesce('1' || source, '0') AS tree FROM documents),
        leaf AS (SELECT row, tree, doc_id, sha256({" || ".join(_merkle_field(c) for c in merkle.FIELDS)}) AS node,
            CASE WHEN {_CRC} % 5 = 0 THEN sha256({" || ".join(_merkle_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in merkle.FIELDS)}) END AS other FROM d),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node, row) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaf),
        {_merkle_levels("lower_level", "placed")},
        subroot AS (SELECT tree AS source, node, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM lower_level WHERE size = 1),
        {_merkle_levels("upper_level", "subroot")},
        start AS (SELECT row, tree, pos, coalesce(other, node) AS now, '' AS proof FROM placed),
        {_merkle_fold("climb", "start", "lower_level_beside")},
        middle AS (SELECT row, s.tree, s.pos, now, proof FROM climb_end e JOIN subroot s ON e.tree = s.source),
        {_merkle_fold("ascent", "middle", "upper_level_beside")}
        SELECT doc_id, p.node AS leaf, s.node AS subroot, t.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.node AS verified
        FROM placed p JOIN ascent_end e USING (row) JOIN subroot s ON p.tree = s.source, (SELECT node FROM upper_level WHERE size = 1) t
    """,
}
