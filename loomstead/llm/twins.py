"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from loomstead.llm.shards import _FINE, _PREFIX, _STATE, curve_table
from loomstead.llm.target_resampling import BUCKETS

_POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    """The CRC of every byte, by its definition: eight halvings, each with the polynomial if a one falls out."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        table.append(value)
    return table


def _crc(text: str) -> str:
    """CRC of a string expression's UTF-8 bytes, as an unsigned whole number."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _features(table: str, key: str) -> str:
    return f"""
        SELECT {key} AS id, word AS feature FROM (SELECT {key}, unnest({_WORDS}) AS word FROM {table})
        UNION ALL
        SELECT {key}, words[i] || ' ' || words[i + 1] FROM (SELECT {key}, words, unnest(range(1, len(words))) AS i FROM (SELECT {key}, {_WORDS} AS words FROM {table}))
    """


def target_resampling(percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> str:
    return f"""
        WITH found AS ({_features("documents", "doc_id")}), wanted AS ({_features("benchmark", "item_id")}),
        hashed AS (SELECT feature, {_crc("feature")} % {buckets} AS bucket FROM (SELECT feature FROM found UNION SELECT feature FROM wanted)),
        s AS (SELECT bucket, count(*) AS s FROM found JOIN hashed USING (feature) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (feature) GROUP BY 1),
        sizes AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS every, (SELECT coalesce(sum(t), 0) FROM t) AS target),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (every + {buckets}) / ((s + 1)::DOUBLE * (target + {buckets})))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket), sizes
        ), sums AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM found JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (
            SELECT doc_id, len({_WORDS}) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                coalesce((total - ((total % n) + n) % n) // n, 0)
                    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM documents LEFT JOIN sums ON id = doc_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(n_words, 0) >= {least_words} ORDER BY score DESC, doc_id) AS place,
            count(*) FILTER (n_words >= {least_words}) OVER () AS able FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= {percent} * able // 100 THEN place END AS rank FROM ranked
    """


def conversation_repair() -> str:
    """States are strings of a cost of nine digits and an audit, so that the least string is the cheapest and first one."""
    plus = lambda state, cost, letter: f"(lpad(CAST(CAST({state}[:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}')"  # noqa: E731
    put_in_u = "least(u, " + ", ".join(plus(s, 3, "I") for s in "esa") + ")"
    more = "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END"
    stays = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"

    def to(states: str, initial: str) -> str:
        return ", ".join(f"CASE WHEN {stays} THEN CASE WHEN initial = '{initial}' THEN {plus(s, more, 'K')} ELSE {plus(s, f'3 + {more}', 'R')} END ELSE '9' END" for s in states)

    return f"""
        WITH RECURSIVE kinds AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM kinds WHERE kind <> 0
        ), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS initial FROM damaged),
        turns AS (
            SELECT *, row_number() OVER w AS place, lag(initial) OVER w || initial AS pair,
                CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault
            FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
        ), walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS place, '000000000' AS e, '900000000' AS s, '000000003I' AS u, '000000006II' AS a FROM turns
            UNION ALL
            SELECT conv_id, place, e, s, u, least(a, {plus("u", 3, "I")}) FROM (
                SELECT conv_id, place, e, s, {put_in_u} AS u, a FROM (
                    SELECT t.conv_id, t.place, {plus("e", 4, "D")} AS e, least({plus("s", 4, "D")}, CASE WHEN {stays} AND initial = 's' THEN {plus("e", more, "K")} ELSE '9' END) AS s,
                        least({plus("u", 4, "D")}, {to("esa", "u")}) AS u, least({plus("a", 4, "D")}, {to("u", "a")}) AS a
                    FROM walk JOIN turns t ON t.conv_id IS NOT DISTINCT FROM walk.conv_id AND t.place = walk.place + 1))
        ), best AS (SELECT conv_id, arg_max(least(e, a), place) AS best FROM walk GROUP BY conv_id),
        edits AS (SELECT conv_id, CAST(best[:9] AS BIGINT) AS cost, best[10:] AS audit FROM best),
        steps AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM edits),
        made AS (
            SELECT s.conv_id, p, audit[p] AS letter, len(translate(audit[:p], 'D', '')) AS written, role, text, initial
            FROM steps s LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.place = len(translate(audit[:p], 'I', ''))
        ), topped AS (SELECT *, bool_or(written = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY conv_id) AS topped FROM made WHERE letter <> 'D'),
        written AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (written - topped::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
            FROM topped GROUP BY conv_id
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN edits e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
    """


def hilbert_sharding(shards: int = 40, bits: int = 6) -> str:
    dims = ("lang", "source", "size", "doc_id")
    n = len(dims)

    def key(c: str) -> str:
        return f"substr({c}, 1, {_PREFIX})" if c in ("lang", "source") else f"sign({c}) * ((length(bin(abs({c}))) - 1) * {4 << _FINE} + (abs({c}) >> greatest(length(bin(abs({c}))) - 1 - {_FINE}, 0)))"

    bins = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE (rank() OVER (ORDER BY {key(c)} NULLS LAST) - 1) * {1 << bits} // count({c}) OVER () END AS b{i}" for i, c in enumerate(dims))
    corners = ", ".join("CAST(" + " | ".join(f"(((b{i} >> {level}) & 1) << {i})" for i in range(n)) + " AS BIGINT)" for level in reversed(range(bits)))
    mask = (1 << _STATE) - 1
    step = f"lambda w, c: ((w >> {_STATE}) << {n + _STATE}) | {curve_table(n)}[(((w & {mask}) << {n}) | c) + 1]"
    return f"""
        WITH measured AS (
            SELECT doc_id, lang, source, coalesce(octet_length(encode(text)), 0) + 16 AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents
        ), binned AS (SELECT *, {bins} FROM measured),
        indexed AS (SELECT *, list_reduce([{corners}], {step}, 0::BIGINT) >> {_STATE} AS curve FROM binned),
        placed AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32 NULLS FIRST, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM indexed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * {shards} // n AS INTEGER) AS shard,
            place - ((place * {shards} // n) * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve
        FROM placed
    """


#: What links reach: of each node the least one, itself included.
_REACHED = """
        reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
"""


def lattice_dedup(threshold: float = 0.93) -> str:
    """All pairs of one label."""
    return f"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        ), vectors AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM usable WHERE list_dot_product(e, e) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= {threshold} * a.norm * b.norm),
        {_REACHED}, degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(root, vec_id), vec_id) AS component_id, least(coalesce(root, vec_id), vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN degrees ON a = vec_id
    """


def ngram_jaccard_join(width: int = 5, percent: int = 75) -> str:
    """Whole sets, one of each distinct one, joined on every shingle they share."""
    return rf"""
        WITH RECURSIVE cut AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS words FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i : i + {width - 1}], ' ')))) END AS shingles
            FROM cut
        ), named AS (SELECT doc_id, len(shingles) AS n, shingles, CASE WHEN len(shingles) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(shingles, chr(10)))) ELSE doc_id END AS own FROM sets),
        singles AS (SELECT doc_id AS own, n, unnest(shingles) AS shingle FROM named WHERE doc_id = own),
        common AS (SELECT a.own AS a, b.own AS b, a.n AS na, b.n AS nb, count(*) AS c FROM singles a JOIN singles b USING (shingle) WHERE a.own <> b.own GROUP BY ALL),
        links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)), {_REACHED}
        SELECT doc_id, n AS n_shingles, least(coalesce(root, own), own) AS component_id FROM named LEFT JOIN least ON node = own
    """


SQL = {
    "op3_lattice_dedup": lattice_dedup(),
    "op10_ngram_jaccard_join": ngram_jaccard_join(),
    "op11_target_resampling": target_resampling(),
    "op12_conversation_repair": conversation_repair(),
    "op13_hilbert_sharding": hilbert_sharding(),
}
