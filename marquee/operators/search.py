"""Vector search: filtered cosine top-k (V2), hybrid-score top-k (V3) and the
batch kNN join (V4).

Single-request search is LIMIT-then-LATERAL, as in the reference: the filtered
catalogue is scored and reduced to the top k (TakeOrderedAndProject, a
per-partition top-k merged in one small task), the k ids come back to the
driver (bounded by the clamped limit), and only those k movies are re-read --
the ids become an IN filter that reaches the Parquet scans -- to attach their
top-5 cast. The cast tables are never scanned in full for one request.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.vector import cosine_literal
from marquee.operators.cast import top_cast
from marquee.operators.filters import (
    MOVIE_TITLE_TYPES, actor_all, actor_any, genre_filter, range_filter,
    title_type_filter)
from marquee.session import reliable_checkpoint, ship_package

# The hybrid score weights (similarity, rating, votes) and the
# result cap of the search service.
HYBRID_WEIGHTS = (0.60, 0.30, 0.10)
MAX_RESULTS = 15


def clamp_limit(limit: int | None, max_results: int = MAX_RESULTS) -> int:
    """limit null -> max; else clamp to [1, max] (max itself at least 1)."""
    mx = max(1, int(max_results))
    if limit is None:
        return mx
    return min(max(1, int(limit)), mx)


def hybrid_score(sim, w=HYBRID_WEIGHTS):
    """0.60*sim + 0.30*min(coalesce(rating,0)/10, 1) + 0.10*log10(max(coalesce(votes,0),1)).
    The votes term is not capped."""
    return (F.lit(w[0]) * sim
            + F.lit(w[1]) * F.least(F.coalesce(F.col("rating"), F.lit(0.0)) / F.lit(10.0), F.lit(1.0))
            + F.lit(w[2]) * F.log10(F.greatest(F.coalesce(F.col("votes"), F.lit(0)), F.lit(1)).cast("double")))


def _norm(catalog: DataFrame):
    return "embedding_norm" if "embedding_norm" in catalog.columns else None


#: Up to this many winners come to the driver as whole rows (they are the
#: result) and go into the cast's scan as an IN list; more stay in a written table.
COLLECT_TOP_K_MAX = 10_000


def _top_k_then_cast(scored: DataFrame, score_col: str, k: int, cast: DataFrame,
                     people: DataFrame, cast_k: int) -> DataFrame:
    """The k best rows, found in one pass and kept whole; their position is
    the rank, and only their cast is read."""
    top = scored.orderBy(F.desc(score_col), F.asc("id")).limit(k)
    if k <= COLLECT_TOP_K_MAX:
        rows = [(*r, i + 1) for i, r in enumerate(top.collect())]
        top = scored.sparkSession.createDataFrame(rows, T.StructType([*scored.schema.fields, T.StructField("rank", T.IntegerType())]))
        at = scored.columns.index("id")
        tc = F.broadcast(top_cast(cast, people, cast_k, movie_ids=[r[at] for r in rows]))  # a row for each of the k
    else:
        # A limit leaves one ordered partition: its row numbers are the ranks.
        top = reliable_checkpoint(top.withColumn("rank", (F.monotonically_increasing_id() + 1).cast("int")))
        ids = top.select(F.col("id").alias("movie_id"))
        tc = top_cast(cast.join(ids, "movie_id", "left_semi"), people, cast_k)
    return top.join(tc, F.col("id") == tc["movie_id"], "left").drop("movie_id")


def search(catalog: DataFrame, cast: DataFrame, people: DataFrame,
           qvec: Sequence[float], limit: int | None = None,
           max_results: int = MAX_RESULTS, from_year=None, to_year=None,
           runtime_max=None, min_rating=None, include_genres=None,
           exclude_genres=None, actors=None,
           title_types: Sequence[str] = MOVIE_TITLE_TYPES,
           case_sensitive: bool = True, cast_k: int = 5) -> DataFrame:
    """V2: embedding NOT NULL, title type, F2, F3, F5 (fuzzy all-of actors);
    order by similarity DESC (id breaks ties), limit clamped to
    [1, max_results]; top-5 cast attached after the limit.

    Zero-norm embeddings score NULL and are dropped (the reference would
    rank their NaN first)."""
    k = clamp_limit(limit, max_results)
    base = catalog.filter(F.col("embedding").isNotNull())
    base = title_type_filter(base, title_types)
    base = range_filter(base, from_year, to_year, runtime_max, min_rating)
    base = genre_filter(base, include_genres, exclude_genres, case_sensitive)
    base = actor_all(base, cast, people, actors)
    scored = (base.withColumn("similarity", cosine_literal("embedding", qvec, _norm(catalog)))
              .filter(F.col("similarity").isNotNull())
              .select("id", "tconst", "primary_title", "start_year", "rating", "votes",
                      "genres", "plot", "title_type", "runtime_minutes", "is_adult",
                      "similarity"))
    return _top_k_then_cast(scored, "similarity", k, cast, people, cast_k)


def hybrid_search(catalog: DataFrame, cast: DataFrame, people: DataFrame,
                  qvec: Sequence[float], limit: int = 10, from_year=None,
                  to_year=None, runtime_max=None, min_rating=None,
                  include_genres=None, exclude_genres=None, actor_names=None,
                  weights=HYBRID_WEIGHTS, cast_k: int = 5) -> DataFrame:
    """V3: filters F2 + F3 + F4 (exact any-of actors), no title-type filter;
    score = hybrid_score(sim); top ``limit`` by score (id breaks ties)."""
    base = catalog.filter(F.col("embedding").isNotNull())
    base = range_filter(base, from_year, to_year, runtime_max, min_rating)
    base = genre_filter(base, include_genres, exclude_genres)
    base = actor_any(base, cast, people, [a.lower() for a in (actor_names or []) if a])
    sim = cosine_literal("embedding", qvec, _norm(catalog))
    scored = (base.withColumn("sim", sim).filter(F.col("sim").isNotNull())
              .withColumn("score", hybrid_score(F.col("sim"), weights))
              .select("id", "tconst", "primary_title", "start_year", "rating", "votes",
                      "sim", "score", "genres", "plot"))
    return _top_k_then_cast(scored, "score", max(1, int(limit)), cast, people, cast_k)


# ---------------------------------------------------------------------------
# V4: batch kNN join
# ---------------------------------------------------------------------------

REQUEST_FILTERS = ("from_year", "to_year", "runtime_max", "min_rating",
                   "include_genres", "exclude_genres")


def _actor_tokens(mode: str):
    """Per-request actor filter keys: V2 mode -> stripped fuzzy tokens (F5,
    all must match), V3 mode -> lower-cased exact names (F4, any may match)."""
    arr = F.coalesce(F.col("actors"), F.array().cast("array<string>"))
    if mode == "hybrid":
        keys = F.transform(arr, lambda a: F.lower(a))
    else:
        keys = F.transform(arr, lambda a: F.regexp_replace(F.lower(a), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(keys, lambda t: t.isNotNull() & (t != "")))


#: Tokens that one automaton holds; more are dealt into blocks.
TOKEN_BLOCK = 100_000


def _token_hits(people: DataFrame, tokens: DataFrame) -> DataFrame:
    """(person_id, token) for every person whose stripped lower name contains
    a token: one Aho-Corasick pass per name. Up to ``TOKEN_BLOCK`` tokens are
    one broadcast automaton; more are dealt into blocks that meet blocks of
    people in cogroup tasks, so nothing unbounded reaches the driver."""
    import ahocorasick

    from marquee.operators.filters import stripped_name
    spark = people.sparkSession
    names = (people.select(F.col("id").alias("person_id"), stripped_name("primary_name").alias("sname"))
             .filter(F.col("sname") != ""))

    def automaton(toks):
        a = ahocorasick.Automaton()
        for t in toks:
            a.add_word(t, t)
        if len(a):
            a.make_automaton()
        return a

    def hits(a, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(i, t) for i, n in zip(pdf["person_id"], pdf["sname"])
                 for t in ({x for _, x in a.iter(n)} if len(a) else ())]
        return pd.DataFrame(found, columns=["person_id", "token"]).astype({"person_id": "int64"})

    n = tokens.count()
    if n <= TOKEN_BLOCK:
        toks_b = spark.sparkContext.broadcast([r[0] for r in tokens.collect()])

        def match(it):
            a = automaton(toks_b.value)
            for pdf in it:
                yield hits(a, pdf)

        return names.mapInPandas(match, "person_id long, token string")
    blocks = math.ceil(n / TOKEN_BLOCK)
    cells = max(1, math.ceil(names.count() / TOKEN_BLOCK))
    t = (tokens.withColumn("tb", F.pmod(F.xxhash64("token"), F.lit(blocks)))
         .withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>"))))
    p = (names.withColumn("pb", F.pmod(F.xxhash64("person_id"), F.lit(cells)))
         .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    return (t.groupBy("tb", "pb").cogroup(p.groupBy("tb", "pb"))
            .applyInPandas(lambda tp, pp: hits(automaton(tp["token"]), pp), "person_id long, token string"))


def _movie_tokens(req: DataFrame, cast: DataFrame, people: DataFrame, mode: str) -> DataFrame:
    """(id, matched): the requests' filter tokens that a movie's cast matches,
    aggregated once per movie; no (request, movie) rows arise."""
    from marquee.operators.filters import ACTOR_CATEGORIES
    tokens = req.select(F.explode("_tokens").alias("token")).distinct()
    if mode == "hybrid":  # exact lower-cased name
        hits = (people.select(F.col("id").alias("person_id"), F.lower("primary_name").alias("token"))
                .join(tokens, "token").select("person_id", "token"))
    else:
        hits = _token_hits(people, tokens)
    return (cast.filter(F.col("category").isin(*ACTOR_CATEGORIES)).select("movie_id", "person_id")
            .join(hits, "person_id").groupBy(F.col("movie_id").alias("id"))
            .agg(F.collect_set("token").alias("matched")))


_KNN_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("limit", T.LongType()),
])


def _codes(lists, vocab: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, vocabulary code) of every list entry that the vocabulary has."""
    flat = pd.Series(list(lists)).reset_index(drop=True).explode().dropna()
    code = vocab.get_indexer(flat.to_numpy())
    return flat.index.to_numpy()[code >= 0], code[code >= 0]


def _requests_payload(pdf: pd.DataFrame, k: int) -> dict:
    """Pack a bounded block of requests into numpy arrays."""
    n = len(pdf)
    def opt(name):
        if name not in pdf.columns:
            return np.full(n, np.nan)
        return pd.to_numeric(pdf[name], errors="coerce").astype("float64").to_numpy()
    q = (np.stack([np.asarray(v, dtype=np.float64) for v in pdf["qvec"].values])
         if n else np.zeros((0, 0)))
    norms = np.linalg.norm(q, axis=1) if n else np.zeros(0)
    ok = norms > 0
    q_unit = q / np.where(ok, norms, 1.0)[:, None] if n else q
    def lists(name):
        col = pdf[name].values if name in pdf.columns else [None] * n
        return [[v for v in (x if x is not None else []) if v is not None and v.strip() != ""]
                for x in col]
    inc, exc, tok = lists("include_genres"), lists("exclude_genres"), lists("_tokens")
    vocab = pd.Index(sorted({v for x in inc + exc for v in x}), dtype=object)
    tokens = pd.Index(sorted({v for x in tok for v in x}), dtype=object)
    def matrix(vals):
        m = np.zeros((n, len(vocab)), dtype=np.float32)
        m[_codes(vals, vocab)] = 1.0
        return m
    inc_m, exc_m = matrix(inc), matrix(exc)
    limit = opt("limit")
    return {
        "ids": pdf["request_id"].to_numpy(dtype=np.int64), "q": q_unit, "ok": ok,
        "from_year": opt("from_year"), "to_year": opt("to_year"),
        "runtime_max": opt("runtime_max"), "min_rating": opt("min_rating"),
        "vocab": vocab, "inc": inc_m, "has_inc": inc_m.sum(axis=1) > 0,
        "exc": exc_m, "has_exc": exc_m.sum(axis=1) > 0,
        "tokens": tokens, "asked": _codes(tok, tokens),
        "limit": np.where(np.isnan(limit), k, np.clip(limit, 1, k)).astype(np.int64),
    }


def _empty_candidates() -> pd.DataFrame:
    return pd.DataFrame({"request_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"),
                         "similarity": pd.Series(dtype="float64"),
                         "score": pd.Series(dtype="float64"), "limit": pd.Series(dtype="int64")})


def _actor_mask(req: dict, s: int, e: int, movie: np.ndarray, code: np.ndarray,
                n_movies: int, mode: str) -> np.ndarray | None:
    """Which movies pass the actor filter of requests s..e: a product of the
    requests' and the movies' token incidence. None: no request has one."""
    rows, asked = req["asked"]
    lo, hi = np.searchsorted(rows, [s, e])
    if lo == hi:
        return None
    used, place = np.unique(asked[lo:hi], return_inverse=True)
    want = np.zeros((e - s, len(used)), np.float32)
    want[rows[lo:hi] - s, place] = 1.0
    need = want.sum(axis=1)
    at = np.minimum(np.searchsorted(used, code), len(used) - 1)
    mine = used[at] == code
    some, column = np.unique(movie[mine], return_inverse=True)
    have = np.zeros((len(used), len(some)), np.float32)
    have[at[mine], column] = 1.0
    got = want @ have
    out = np.repeat(need[:, None] == 0, n_movies, axis=1)
    out[:, some] |= (got > 0) if mode == "hybrid" else (got == need[:, None])
    return out


#: Movies that one tile of scores has at most: with ``req_block`` requests a
#: tile's matrices take some ten MB each, whatever a batch or a cell holds.
TILE_MOVIES = 4096
#: Share of a tile's pairs up to which the filters look at single pairs.
FEW_PAIRS = 1 / 8
#: Single pairs times genres that are looked at in one step.
PAIR_CELLS = 4 << 20


def _best_pairs(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best k finite scores by (score, id); the
    columns are in id order, so ties never pass more than k of them."""
    kk = min(k, score.shape[1])
    if kk <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    thr = np.partition(score, score.shape[1] - kk, axis=1)[:, score.shape[1] - kk][:, None]
    ri, ci = np.nonzero((score >= thr) & (score > -np.inf))
    return _first_k(kk, ri, ci, score[ri, ci], ri, ci)


def _first_k(k: int, row: np.ndarray, column: np.ndarray, score: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """``values`` of each row's first k entries by (score descending, column)."""
    order = np.lexsort((column, -score, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return tuple(v[order] for v in values)


def _score_block(pdf: pd.DataFrame, req: dict, k: int, mode: str, weights,
                 req_block: int) -> pd.DataFrame:
    """:func:`_score_tiles` as one frame."""
    out = list(_score_tiles(pdf, req, k, mode, weights, req_block))
    return pd.concat(out, ignore_index=True) if out else _empty_candidates()


def _score_tiles(pdf: pd.DataFrame, req: dict, k: int, mode: str, weights,
                 req_block: int, floor: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Score one catalogue batch against a block of requests and keep, per
    request, its best k by (score, id): the order of the global ranking. Done
    in tiles of ``req_block`` requests and ``TILE_MOVIES`` movies, the best so
    far carried from tile to tile; one frame per block of requests.

    ``floor``: per request a score that k movies are known to reach (-inf: not
    known), raised here; a lower score is left out, so that after the first
    tiles the filters look at few pairs. Kept from batch to batch by the caller."""
    pdf = pdf.sort_values("id", kind="stable")
    emb = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"].values])
    norms = np.linalg.norm(emb, axis=1)
    valid = norms > 0
    emb /= np.where(valid, norms, 1.0)[:, None]
    year = pdf["start_year"].astype("float64").to_numpy()
    runtime = pdf["runtime_minutes"].astype("float64").to_numpy()
    rating = pdf["rating"].astype("float64").to_numpy()
    votes = pdf["votes"].astype("float64").to_numpy()
    ids = pdf["id"].to_numpy(dtype=np.int64)
    vocab = req["vocab"]
    genre = _codes(pdf["genres"], vocab) if len(vocab) else None
    acted = len(req["tokens"]) > 0
    if acted:
        movie, code = _codes(pdf["matched"], req["tokens"])
    prior = None
    if mode == "hybrid":
        prior = (weights[1] * np.minimum(np.nan_to_num(rating, nan=0.0) / 10.0, 1.0)
                 + weights[2] * np.log10(np.maximum(np.nan_to_num(votes, nan=0.0), 1.0)))
    n_req = len(req["ids"])

    if floor is None:
        floor = np.full(n_req, -np.inf)
    bounds = [(req[name], col, op) for name, col, op in (
        ("from_year", year, np.greater_equal), ("to_year", year, np.less_equal),
        ("runtime_max", runtime, np.less_equal), ("min_rating", rating, np.greater_equal))]

    def tile(s, e, a, b):
        """Row, column, similarity and score of the pairs of one tile that may
        be among the best, sorted by row and rank."""
        sim = req["q"][s:e] @ emb[a:b].T
        score = weights[0] * sim + prior[None, a:b] if mode == "hybrid" else sim
        mask = score >= floor[s:e, None]
        if acted:
            lo, hi = np.searchsorted(movie, [a, b])
            passed = _actor_mask(req, s, e, movie[lo:hi] - a, code[lo:hi], b - a, mode)
            if passed is not None:
                mask &= passed
        g = None
        if genre is not None:
            lo, hi = np.searchsorted(genre[0], [a, b])
            g = np.zeros((b - a, len(vocab)), dtype=np.float32)
            g[genre[0][lo:hi] - a, genre[1][lo:hi]] = 1.0
        if np.count_nonzero(mask) > FEW_PAIRS * mask.size:
            mask &= valid[None, a:b] & req["ok"][s:e, None]
            for bound, col, op in bounds:
                given = ~np.isnan(bound[s:e])
                if given.any():
                    mask &= ~given[:, None] | op(col[None, a:b], bound[s:e, None])
            if g is not None:
                hit_inc = (req["inc"][s:e] @ g.T) > 0
                hit_exc = (req["exc"][s:e] @ g.T) > 0
                mask &= ~req["has_inc"][s:e, None] | hit_inc
                mask &= ~(req["has_exc"][s:e, None] & hit_exc)
            ri, ci = _best_pairs(np.where(mask, score, -np.inf), k)
            return ri, ci, sim[ri, ci], score[ri, ci]
        ri, ci = np.nonzero(mask)
        r, m = s + ri, a + ci
        keep = valid[m] & req["ok"][r]
        for bound, col, op in bounds:
            keep &= np.isnan(bound[r]) | op(col[m], bound[r])
        if g is not None:
            step = max(1, PAIR_CELLS // len(vocab))
            for x in range(0, len(ri), step):
                some, has = r[x:x + step], g[ci[x:x + step]]
                hit_inc = (req["inc"][some] * has).any(axis=1)
                hit_exc = (req["exc"][some] * has).any(axis=1)
                keep[x:x + step] &= (~req["has_inc"][some] | hit_inc) & ~(req["has_exc"][some] & hit_exc)
        ri, ci = ri[keep], ci[keep]
        return _first_k(k, ri, ci, score[ri, ci], ri, ci, sim[ri, ci], score[ri, ci])

    for s in range(0, n_req, req_block):
        e = min(n_req, s + req_block)
        best = None  # rows, movies, similarities and scores of the tiles so far
        with np.errstate(invalid="ignore"):
            for a in range(0, len(ids), TILE_MOVIES):
                b = min(len(ids), a + TILE_MOVIES)
                ri, bi, sims, scores = tile(s, e, a, b)
                found = (ri, a + bi, sims, scores)
                if best is not None:
                    found = tuple(np.concatenate(x) for x in zip(best, found))
                    found = _first_k(k, found[0], found[1], found[3], *found)
                best = found
                n = np.bincount(best[0], minlength=e - s)
                full = n >= k
                floor[s:e][full] = np.maximum(floor[s:e][full], best[3][np.cumsum(n)[full] - 1])
        if best is not None and len(best[0]):
            ri, mi, sims, scores = best
            yield pd.DataFrame({"request_id": req["ids"][s:e][ri], "id": ids[mi], "similarity": sims, "score": scores,
                                "limit": req["limit"][s:e][ri]})


#: A request side up to this size is broadcast; a cell of the blocked product
#: holds about ``CELL_BYTES`` of the catalogue's vectors.
MAX_REQUEST_BYTES = 256 << 20
CELL_BYTES = 8 << 20


def knn_join(requests: DataFrame, catalog: DataFrame, k: int = 10,
             mode: str = "similarity", weights=HYBRID_WEIGHTS,
             title_types: Sequence[str] | None = None,
             max_broadcast_requests: int = 20_000, req_block: int = 512,
             cast: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """V4: the per-request search for a whole table of requests.

    ``requests``: request_id, qvec and optionally the filter columns in
    ``REQUEST_FILTERS``, ``actors`` and ``limit`` (null: k; else clamped to
    [1, k]). ``mode`` = "similarity" (V2 order, fuzzy all-of actor filter F5)
    or "hybrid" (V3, exact any-of F4).

    Plan, one path for all requests: the request side is checked in rows and
    bytes (vectors and lists) and broadcast; the catalogue -- the large side
    -- is streamed through ``mapInPandas`` where each Arrow batch is scored
    against the block with one matrix product and reduced to a local top-k per
    request. Actor filters are masks, as genres are: the cast is aggregated
    once to the tokens that each movie matches, joined by movie id. Only k
    candidates per request per batch reach the shuffle; the final
    ``row_number()`` per request then runs over bounded groups. No cross join
    is planned and no pair set is materialised.
    """
    spark = requests.sparkSession
    ship_package(spark)
    cat = catalog.filter(F.col("embedding").isNotNull())
    if title_types is not None:
        cat = title_type_filter(cat, title_types)
    cat = cat.select("id", "embedding", "start_year", "runtime_minutes", "rating",
                     "votes", "genres")
    req_cols = ["request_id", "qvec"] + [c for c in (*REQUEST_FILTERS, "limit") if c in requests.columns]
    if "actors" in requests.columns:
        if cast is None or people is None:
            raise ValueError("requests with actors need the cast and people tables")
        requests = requests.withColumn("_tokens", _actor_tokens(mode))
        cat = cat.join(_movie_tokens(requests, cast, people, mode), "id", "left")
        req_cols.append("_tokens")
    req = requests.select(*req_cols)
    # Size check: only a request side proven small is shipped to executors.
    words = [c for c in ("include_genres", "exclude_genres", "_tokens") if c in req_cols]
    size = F.size("qvec").cast("long") * 8 + 128
    for c in words:
        size = size + F.coalesce(F.length(F.array_join(c, " ")) * 4, F.lit(0))
    n, n_bytes, width = req.agg(F.count(F.lit(1)), F.sum(size), F.max(F.size("qvec"))).first()
    if n <= max_broadcast_requests and (n_bytes or 0) <= MAX_REQUEST_BYTES:
        payload = spark.sparkContext.broadcast(_requests_payload(req.toPandas(), k))

        def score_parts(it):
            reqd = payload.value
            floor = np.full(len(reqd["ids"]), -np.inf)
            for pdf in it:
                if len(pdf):
                    yield from _score_tiles(pdf, reqd, k, mode, weights, req_block, floor)

        cand = cat.mapInPandas(score_parts, _KNN_SCHEMA)
    else:
        cand = _blocked_candidates(req, cat, k, mode, weights, req_block,
                                   max(math.ceil(n / max_broadcast_requests),
                                       math.ceil(n_bytes / MAX_REQUEST_BYTES)), width)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.asc("id"))
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= k) & (F.col("rank") <= F.col("limit"))).drop("limit"))


def _blocked_candidates(req: DataFrame, cat: DataFrame, k: int, mode: str,
                        weights, req_block: int, nb_r: int, width: int) -> DataFrame:
    """Large request tables: a blocked nested-loop product. Requests are
    hashed into ``nb_r`` blocks, the catalogue into blocks of about
    ``CELL_BYTES`` of vectors; each (request block, catalogue block) cell is
    one cogroup task that does a matrix product and keeps a local top-k.
    Nothing passes through the driver and no pair is emitted beyond the local
    top-k."""
    nb_c = max(1, math.ceil(cat.select("id").count() * 8 * max(width, 1) / CELL_BYTES))
    r = (req.withColumn("rb", F.pmod(F.xxhash64("request_id"), F.lit(nb_r)))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nb_c - 1)).cast("array<bigint>"))))
    c = (cat.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(nb_c)))
         .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nb_r - 1)).cast("array<bigint>"))))

    def cell(rpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(rpdf) == 0 or len(cpdf) == 0:
            return _empty_candidates()
        return _score_block(cpdf, _requests_payload(rpdf, k), k, mode, weights, req_block)

    return (r.groupBy("rb", "cb").cogroup(c.groupBy("rb", "cb"))
            .applyInPandas(cell, _KNN_SCHEMA))
