"""The registered queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    chosen_path,
    collocations,
    content_sort,
    drift_clusters,
    fm_index,
    line_chunks,
    link_graph,
    mixing,
    packing,
    quality,
    secret_owners,
    toxicity,
    vector_file,
)
from tabloom.llm.common import session_area, table, whole_text, word_count


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, packing.byte_bpe_50k())
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_id",
    )


def op2_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    area = session_area(spark, "vector-file")
    return vector_file.search(vectors, F.col("vec_id") % 20 == 0, area)


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = line_chunks.dedup_lines(docs, session_area(spark, "line-chunks"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


URL_RULES = (
    link_graph.Rule("org/", "allow"),
    link_graph.Rule("example.org/es/", "block"),
    link_graph.Rule("example.org/en/1", "block"),
    link_graph.Rule("com/fr/", "allow"),
    link_graph.Rule("com/de/", "block"),
)


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = link_graph.filter_urls(pages, URL_RULES, session_area(spark, "link-graph"), steps=None)
    return found.drop("trust", "distrust")


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = fm_index.dedup_substrings(docs, session_area(spark, "fm-index"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def mix_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix of documents with one source each, and (source, source_size, target).

    Sources by name, null last, weigh 5, 2, 1, 5, 2, ... and share 150 % of all words.
    """
    sizes = mixing.pattern_sizes(rows)
    totals = {members[0]: words for members, words in sizes.items()}
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(order)}
    targets = mixing.water_fill(totals, weights, mixing.SHARE * sum(totals.values()))
    quotas = {s: round(target) for s, target in targets.items()}
    kinds = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64()}
    facts = [order, [totals[s] for s in order], [float(targets[s]) for s in order]]
    columns = [pa.array(values, kind) for values, kind in zip(facts, kinds.values(), strict=True)]
    sources = rows.sparkSession.createDataFrame(pa.table(columns, list(kinds)))
    return mixing.select_documents(rows, mixing.cheapest_flow(sizes, quotas)), sources


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    area = session_area(spark, "mixing")
    rows = mixing.sized(docs, word_count(whole_text()), F.array("source"), area)
    mix, sources = mix_sources(rows)
    mix = mix.withColumn("source", F.col("members")[0]).alias("m")
    joined = mix.join(sources.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source")))
    return joined.select("doc_id", F.col("words").alias("size"), "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    area = session_area(spark, "toxicity")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), area)
    return toxicity.score_toxicity(docs, model)


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = content_sort.content_sort(docs, session_area(spark, "content-sort"), carry=("doc_id",))
    return found.select(F.col("row.doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = chosen_path.join_similar(docs, session_area(spark, "chosen-path"))
    return found.select("doc_id", "class_id", "links", "group_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return collocations.mine_collocations(docs, session_area(spark, "collocations"))


def op12_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    docs = table(spark, sf_dir, "documents")
    found = secret_owners.find_secrets(docs, session_area(spark, "secret-owners"))
    base = {kind: F.col(kind) for kind in secret_owners.KINDS[:3]}
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(secret_owners.spans_text(base), 256).alias("base_sha256"),
        secret_owners.spans_text({**base, "live": F.col("live")}).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_example",
    )


def op13_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return drift_clusters.cluster_vectors(vectors, session_area(spark, "drift-clusters"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_vector_file": op2_vector_file,
    "op3_line_chunks": op3_line_chunks,
    "op4_link_graph": op4_link_graph,
    "op5_fm_index": op5_fm_index,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_content_sort": op8_content_sort,
    "op9_quality": op9_quality,
    "op10_chosen_path": op10_chosen_path,
    "op11_collocations": op11_collocations,
    "op12_secret_owners": op12_secret_owners,
    "op13_drift_clusters": op13_drift_clusters,
}

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"



def _link_graph_sql() -> str:
    """The rounds written out one after the other."""
    fits = [
        f"""WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')
            THEN {{{{'rule': '{r.text}', 'ruled': '{r.verdict}'}}}}"""
        for r in sorted(URL_RULES, key=lambda r: -len(r.text))
        for name, _, rest in [r.text.partition("/")]
    ]
    low = f"translate({{}}, '{link_graph.UPPER}', '{link_graph.LOWER}')"
    host = low.format("regexp_extract({}, '://([^/?#]*)', 1)")
    link = link_graph.LINK.replace("'", "''")
    rounds = "".join(
        f""",
          m{i} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (
            SELECT kind, host, 0.15::DOUBLE * mass AS mass FROM seeds
            UNION ALL SELECT s.kind, s."to", m.mass * s.share * 0.85::DOUBLE
            FROM shares s JOIN m{i - 1} m ON m.kind = s.kind AND m.host = s."at") GROUP BY ALL)"""
        for i in range(1, link_graph.STEPS + 1)
    )
    return f"""
        WITH parts AS (SELECT page_id, {host.format("coalesce(url, '')")} AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
            coalesce(html, '') AS html FROM pages),
          found AS (SELECT *, CASE {" ".join(fits).format()} END AS fit FROM parts),
          links AS (SELECT source, target, count(*) AS links FROM (
            SELECT host AS source, {host.format("CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END")}
              AS target FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM parts))
            WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
          ways AS (SELECT 'trust' AS kind, source AS "at", target AS "to", links FROM links
            UNION ALL SELECT 'distrust', target, source, links FROM links),
          shares AS MATERIALIZED (SELECT kind, "at", "to",
            links / sum(links) OVER (PARTITION BY kind, "at") AS share FROM ways),
          shared AS (SELECT host, count(*) FILTER (fit.ruled = 'allow') / count(*) AS allow,
            count(*) FILTER (fit.ruled = 'block') / count(*) AS block
            FROM found WHERE host <> '' GROUP BY host),
          seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, allow AS mass FROM shared WHERE allow > 0
            UNION ALL SELECT 'distrust', host, block FROM shared WHERE block > 0),
          m0 AS (SELECT kind, host, 0.15::DOUBLE * mass AS mass FROM seeds){rounds},
          scores AS (SELECT host, round(sum(CASE kind WHEN 'distrust' THEN mass ELSE -mass END), 9)
            AS excess FROM m{link_graph.STEPS} GROUP BY host)
        SELECT page_id, f.host, path, fit.rule AS rule,
          coalesce(fit.ruled, CASE WHEN excess > 0 THEN 'block' ELSE 'allow' END) AS verdict
        FROM found f LEFT JOIN scores s ON f.host = s.host"""


def _secrets_sql() -> str:
    """Matches by a window over each document's parts between matches."""
    so = secret_owners
    kinds = [("assign", so.ASSIGN, 2), ("access", so.ACCESS, 0), ("hex", so.HEX, 0), ("token", so.TOKEN, 0)]
    found = " UNION ALL ".join(
        f"""SELECT row, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS whole,
              unnest(regexp_extract_all(text, '{p}', {group})) AS value,
              unnest(list_slice(string_split_regex(text, '{p}'), 1, -2)) AS gap,
              unnest(range(len(regexp_extract_all(text, '{p}')))) AS i
            FROM d WHERE regexp_matches(text, '{p}')"""
        for kind, pattern, group in kinds
        for p in [pattern.replace("'", "''")]
    )
    base = "FILTER (kind <> 'live')"
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth)"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text
            FROM documents),
          m AS ({found}),
          p AS (SELECT *, CAST(sum(len(gap) + len(whole)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS stop
            FROM m),
          s AS MATERIALIZED (SELECT row, kind, value, stop - len(whole) AS start, stop FROM p
            WHERE kind <> 'assign' OR len(value) >= {so.ASSIGNED}),
          t AS MATERIALIZED (SELECT row, value, start, stop FROM s WHERE kind = 'token'
            AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND len(list_distinct(string_split(value, ''))) >= {so.VARIETY}),
          o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (source, doc_id)) AS places
            FROM t JOIN d USING (row) GROUP BY value),
          c AS (SELECT row, start, stop, CASE WHEN owners >= {so.EXAMPLE_OWNERS} THEN 'example'
              WHEN owners = 1 AND places <= {so.LIVE_REPOSITORIES} THEN 'live' END AS kind
            FROM t JOIN o USING (value)),
          a AS (SELECT row, kind, start, stop FROM s WHERE kind <> 'token'
            UNION ALL SELECT row, kind, start, stop FROM c WHERE kind = 'live'),
          g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
              count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live,
              {text} AS spans, {text} {base} AS base
            FROM (SELECT *, list_position(['assign', 'access', 'hex', 'live'], kind) AS nth FROM a) GROUP BY row),
          e AS (SELECT row, count(*) AS n_example FROM c WHERE kind = 'example' GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
          coalesce(n_example, 0) AS n_example
        FROM d LEFT JOIN g USING (row) LEFT JOIN e USING (row)"""


def _clusters_sql() -> str:
    """Plain rounds written out: assign all vectors, average each cluster, three times."""
    rounds = "".join(
        f""",
          a{i} AS MATERIALIZED (SELECT row, arg_min(number, (d, number)) AS cluster, min(d) AS distance
            FROM (SELECT row, number, list_sum(list_transform(list_zip(v.cells, c.cells),
                lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i} c) GROUP BY row),
          c{i + 1} AS MATERIALIZED (SELECT number, coalesce(new, c.cells) AS cells FROM c{i} c LEFT JOIN (
            SELECT cluster, list(mean ORDER BY place) AS new FROM (
              SELECT cluster, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean FROM (
                SELECT cluster, unnest(v.cells) AS x, unnest(range(64)) AS place
                FROM v JOIN a{i} USING (row)) GROUP BY ALL) GROUP BY cluster) ON cluster = number)"""
        for i in range(4)
    )
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding,
              lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS cells FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
          c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), cells) - 1 AS number,
            cells FROM v QUALIFY number < 16){rounds}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
          CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
          CAST(sum(distance) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c3.cells, ',')) AS centroid_sha256
        FROM a3 JOIN v USING (row) JOIN c3 ON number = cluster"""


ORACLES = {
    "op2_vector_file": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding,
              lambda x: floor(CAST(x AS DOUBLE) * 64)) AS parts
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
          s AS (SELECT q.row AS asked, q.vec_id AS query_id, c.vec_id,
              CAST(list_inner_product(q.parts, c.parts) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row <> q.row
              AND len(q.parts) = len(c.parts))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id)
            AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY rank <= 20""",
    "op3_line_chunks": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
          l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
          h AS (SELECT *, CAST('0x' || left(md5(line), 8) AS BIGINT) AS h FROM l),
          b AS (SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % 2147483647 % 3 = 0 AS hit FROM h
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
          -- Of neighbouring hits every second closes a chunk, so that each has two lines at least.
          s AS (SELECT *, coalesce(max(pos) FILTER (NOT hit) OVER (PARTITION BY doc_id ORDER BY pos), -1) + 1 AS first,
            count(*) OVER (PARTITION BY doc_id) AS total FROM b),
          e AS (SELECT *, hit AND (pos - first) % 2 = CASE WHEN first = 0 THEN 1 ELSE 0 END
            AND pos <> total - 2 AS closes FROM s),
          c AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
          t AS (SELECT doc_id, chunk, min(pos) AS start, count(*) AS n,
            string_agg(line, chr(10) ORDER BY pos) AS body FROM c GROUP BY ALL),
          r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, body
            ORDER BY doc_id, start) > 1 AS gone FROM t)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines,
          CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
          sha256(coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id""",
    "op4_link_graph": _link_graph_sql(),
    "op5_fm_index": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
          w AS (SELECT doc_id, pos, list_slice(words, pos + 1, pos + 35) AS body
            FROM (SELECT doc_id, words, unnest(range(len(words) - 34)) AS pos FROM d WHERE len(words) > 34)),
          again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY sha256(array_to_string(body, ' '))) > 1
            AS twice FROM w),
          gone AS (SELECT DISTINCT doc_id, pos + unnest(range(35)) AS pos FROM again WHERE twice),
          l AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
          k AS (SELECT l.doc_id, count(*) FILTER (g.pos IS NULL) AS kept,
              string_agg(word, ' ' ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
            FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
          CAST(len(words) - coalesce(kept, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op8_content_sort": f"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'))
                     AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
          row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_collocations": f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(
              translate(coalesce(text, ''), '{collocations.UPPER}', '{collocations.LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents),
          p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
            FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
          s AS (SELECT lang, words, unnest(range(len(words))) AS pos FROM p),
          g AS (SELECT lang, list_slice(words, pos + 1, pos + size) AS phrase, size
            FROM s, (VALUES (1), (2), (3), (4), (5)) AS sizes(size) WHERE pos + size <= len(words)),
          f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL),
          t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
          c AS MATERIALIZED (SELECT lang, phrase, size, a FROM f WHERE size > 1 AND a >= 100),
          k AS (SELECT c.*, l.a AS l, r.a AS r, n,
              CAST(1000 * c.a::HUGEINT * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
            JOIN f l ON l.lang = c.lang AND l.phrase = list_slice(c.phrase, 1, k)
            JOIN f r ON r.lang = c.lang AND r.phrase = list_slice(c.phrase, k + 1, c.size)
            JOIN t ON t.lang = c.lang),
          best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
          inside AS (SELECT lang, list_slice(phrase, pos + 1, pos + part) AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(size)) AS pos FROM c), (VALUES (2), (3), (4)) AS parts(part)
            WHERE part < size AND pos + part <= size GROUP BY ALL),
          kept AS (SELECT b.*, array_to_string(b.phrase, ' ') AS joined FROM best b
            LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
            WHERE coalesce(longer < a, true))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, joined) AS rank,
          joined AS phrase, a, l, r, n, score FROM kept
        QUALIFY rank <= 2000""",
    "op12_secret_owners": _secrets_sql(),
    "op13_drift_clusters": _clusters_sql(),
    # Water filling: sources in order of size / weight are capped while their share is too much.
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
            md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
          s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
          w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
          o AS (SELECT *, sum(source_size) OVER () * 1.5 AS total, sum(weight) OVER () AS weights,
            coalesce(sum(source_size) OVER b, 0) AS size_before,
            coalesce(sum(weight) OVER b, 0) AS weight_before FROM w
            WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          f AS (SELECT *, CAST(total - 2 * size_before AS DOUBLE) AS rest,
              weights - weight_before AS whole FROM o),
          l AS (SELECT rest, whole FROM f WHERE rest * weight / whole <= 2 * source_size
            ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
          t AS (SELECT source, source_size, CAST(least(2 * source_size,
              (SELECT rest FROM l) * weight / (SELECT whole FROM l)) AS DOUBLE) AS target FROM w),
          p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
              CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
          greatest(0, least(size, quota - before))
            + greatest(0, least(size, quota - source_size - before)) AS taken FROM p""",
}
