"""Registration of queries with their SQL."""

from __future__ import annotations

#: Frames, positions, and similarity to the predecessor, as common table expressions.
FRAMES = "f AS (SELECT label AS folder, vec_id AS frame_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
POSITIONS = FRAMES + ", p AS (SELECT folder, frame_id, v, row_number() OVER (PARTITION BY folder ORDER BY frame_id) - 1 AS pos FROM f)"
SIMILARITIES = POSITIONS + ", s AS (SELECT *, CASE WHEN pos > 0 THEN list_cosine_similarity(v, lag(v) OVER (PARTITION BY folder ORDER BY frame_id)) END AS sim FROM p)"


def registrar(queries: dict, oracles: dict):
    def query(sql: str | None = None, name: str | None = None):
        def put(f):
            key = name or f.__name__
            queries[key] = f
            if sql is not None:
                oracles[key] = sql
            return f

        return put

    return query
