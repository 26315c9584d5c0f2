"""SQL of the graph queries: each hop of the loops written out."""

from __future__ import annotations

SIGN = "CASE effect WHEN 'activates' THEN 1 WHEN 'inhibits' THEN -1 ELSE 0 END"


def arcs(least: float) -> str:
    def way(source: str, target: str, branch: int, direction: str) -> str:
        return f"SELECT {source} AS source, {target} AS target, {branch} AS branch, id, effect, {SIGN} AS sign, score FROM {{interactions}} WHERE upper(direction) IN ('{direction}', 'BIDIRECTIONAL') AND score >= {least}"

    return way("entity_a", "entity_b", 0, "A_TO_B") + " UNION ALL " + way("entity_b", "entity_a", 1, "B_TO_A")


def _hops(seeds: list[str], modes: list[str], depth: int) -> str:
    rows = ", ".join(f"('{s}:{m}', '{s}', CAST({-1 if m == 'suppress' else 1} AS DOUBLE))" for s in seeds for m in modes)
    out = [f"f1 AS (SELECT run, seed, seed AS source, parent, 1 AS rnk FROM (VALUES {rows}) t(run, seed, parent))", "v1 AS (SELECT run, seed AS node FROM f1)"]
    for h in range(1, depth + 1):
        out.append(f"s{h} AS (SELECT f.run, f.seed, f.source, a.target, a.id, a.branch, a.sign, f.rnk, f.parent * a.sign * a.score AS new FROM f{h} f JOIN {{arcs}} a ON a.source = f.source)")
        out.append(f"l{h} AS (SELECT * FROM s{h} WHERE sign <> 0 AND target <> seed)")
        if h < depth:
            out.append(
                f"f{h + 1} AS (SELECT run, seed, source, parent, row_number() OVER (PARTITION BY run ORDER BY rnk, branch, id, source) AS rnk FROM (SELECT run, seed, target AS source, new AS parent, rnk, branch, id, "
                f"row_number() OVER (PARTITION BY run, target ORDER BY rnk, branch, id) AS k FROM l{h} WHERE NOT EXISTS (SELECT 1 FROM v{h} v WHERE v.run = l{h}.run AND v.node = l{h}.target)) q WHERE k = 1)"
            )
            out.append(f"v{h + 1} AS (SELECT * FROM v{h} UNION ALL SELECT run, source FROM f{h + 1})")
    return ", ".join(out)


def propagate(seeds: list[str], modes: list[str], depth: int, alpha: float = 0.55) -> str:
    every = " UNION ALL ".join(f"SELECT run, target, new, {h} AS hop FROM l{h}" for h in range(1, depth + 1))
    part = lambda op: f"(1 - coalesce(product(1 - power(least(abs(new), 1), {alpha})) FILTER (WHERE new {op} 0), 1))"
    return (
        f"SELECT * FROM (WITH {_hops(seeds, modes, depth)}, every_one AS ({every}) SELECT split_part(run, ':', 1) AS seed, split_part(run, ':', 2) AS mode, target, round({part('>')} - {part('<')}, 6) + 0.0 AS score, "
        "CAST(min(hop) AS INT) AS hop, CAST(count(*) AS BIGINT) AS arrivals FROM every_one GROUP BY run, target) x"
    )


def arrivals(seeds: list[str], modes: list[str], depth: int) -> str:
    """By seed and mode: how often arcs arrive, and the sum of their scores."""
    every = " UNION ALL ".join(f"SELECT run, new FROM l{h}" for h in range(1, depth + 1))
    return f"SELECT * FROM (WITH {_hops(seeds, modes, depth)} SELECT split_part(run, ':', 1) AS seed, split_part(run, ':', 2) AS mode, count(*) AS n, round(sum(new), 6) AS total FROM ({every}) e GROUP BY run) x"


def excluded(seed: str, depth: int) -> str:
    every = " UNION ALL ".join(f"SELECT source, id, branch, {h} AS hop FROM s{h} WHERE sign = 0" for h in range(1, depth + 1))
    return f"SELECT * FROM (WITH {_hops([seed], ['suppress'], depth)} {every}) x"


def neighbourhood(seeds: list[str], hops: int, limit: int, least: float, kind: str | None = None) -> str:
    """``kind``: an entity type that one end must have."""
    start = ", ".join(f"('{s}')" for s in seeds)
    ctes = [f"n0(node) AS (VALUES {start})", f"e AS (SELECT id, entity_a, entity_b, score FROM {{interactions}} WHERE score >= {least})", "k0 AS (SELECT id, entity_a, entity_b, score, 0 AS hop FROM e WHERE false)", "w0 AS (SELECT node FROM n0)"]
    either = f" AND (entity_a IN (SELECT id FROM {{entities}} WHERE entity_type = '{kind}') OR entity_b IN (SELECT id FROM {{entities}} WHERE entity_type = '{kind}'))" if kind else ""
    for h in range(1, hops + 1):
        p = h - 1
        ctes.append(f"t{h} AS (SELECT * FROM (SELECT e.*, row_number() OVER (ORDER BY score DESC, id) AS place FROM e WHERE entity_a IN (SELECT node FROM n{p}) OR entity_b IN (SELECT node FROM n{p})) q WHERE place <= {limit} - (SELECT count(*) FROM k{p}))")
        ctes.append(f"g{h} AS (SELECT id, entity_a, entity_b, score, {h} AS hop FROM t{h} WHERE id NOT IN (SELECT id FROM k{p}){either})")
        ctes.append(f"k{h} AS (SELECT * FROM k{p} UNION ALL SELECT * FROM g{h})")
        ctes.append(f"n{h} AS (SELECT DISTINCT node FROM (SELECT entity_a AS node FROM g{h} UNION ALL SELECT entity_b FROM g{h}) q WHERE node NOT IN (SELECT node FROM w{p}))")
        ctes.append(f"w{h} AS (SELECT node FROM w{p} UNION ALL SELECT node FROM n{h})")
    return f"SELECT * FROM (WITH {', '.join(ctes)} SELECT id, entity_a, entity_b, score, hop FROM k{hops}) x"


def paths(source: str, target: str, hops: int, limit: int, least: float) -> str:
    parts = []
    for n in range(1, hops + 1):
        tables = "a AS (SELECT * FROM {arcs} WHERE score >= " + str(least) + ")"
        joins = " ".join(f"JOIN a a{i} ON a{i}.source = a{i - 1}.target" for i in range(2, n + 1))
        nodes = [f"a{i}.target" for i in range(1, n)]
        apart = [f"a1.source = '{source}'", f"a{n}.target = '{target}'"] + [f"{x} <> '{source}' AND {x} <> '{target}'" for x in nodes] + [f"{x} <> {y}" for i, x in enumerate(nodes) for y in nodes[i + 1 :]]
        every = range(1, n + 1)
        path = " || '>' || ".join(["a1.source", *[f"a{i}.target" for i in every]])
        edges = " || '>' || ".join(f"a{i}.id" for i in every)
        score = " * ".join(f"a{i}.score" for i in every)
        sign = " * ".join(f"a{i}.sign" for i in every)
        parts.append(f"SELECT * FROM (WITH {tables} SELECT {path} AS path, {edges} AS edges, round({score}, 6) AS score, {n} AS n_hops, {sign} AS net_sign FROM a a1 {joins} WHERE {' AND '.join(apart)}) p{n}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + f") q ORDER BY score DESC, n_hops, edges LIMIT {limit}"
