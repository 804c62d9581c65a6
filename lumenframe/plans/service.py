"""Entry points over a frames table: search, search by image, chat, semantic search, requests."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import encoders
from lumenframe.functions import text as T
from lumenframe.operators import fusion, search, stats, temporal
from lumenframe.plans.cache import ResultCache
from lumenframe.streaming.stateful import TtlCache

MAX_TEXT = 5000
LEVELS = ("minimal", "standard", "rich", "full")
REQUESTS = {"search": ("query",), "translate": ("text",), "image_search": ("folder_name", "image_name"), "chat": ("question",), "metadata": ("folder_name", "image_name"), "semantic_search": ("semantic_query",), "stats": ()}

# fixed values: codes for failures by kind
ERRORS = {ValueError: "invalid_request", KeyError: "not_found", PermissionError: "forbidden", TimeoutError: "timeout"}


def validate_request(kind: str, request: dict) -> str | None:
    """What is wrong with a request, or None."""
    if kind not in REQUESTS:
        return f"unknown request {kind!r}"
    for name in REQUESTS[kind]:
        value = request.get(name)
        if not isinstance(value, str) or not value.strip():
            return f"missing field {name!r}"
        if len(value) > MAX_TEXT:
            return f"{name!r} is longer than {MAX_TEXT}"
    limit = request.get("limit", 50)
    if not isinstance(limit, int) or not 0 < limit <= 1000:
        return "limit must be in 1..1000"
    if request.get("mode", "hybrid") not in (*search.MODES, *search.MODE_NAMES):
        return f"mode must be one of {search.MODES}"
    if request.get("detail_level", "standard") not in LEVELS:
        return "unknown detail_level"
    return None


def error_code(error: Exception) -> str:
    return next((code for kind, code in ERRORS.items() if isinstance(error, kind)), "internal")


BACKENDS = ("container", "remote", "memory")
_REMOTE = "array<struct<metadata:struct<folder_name:string,image_name:string,frame_id:long,file_path:string>,similarity_score:double,rank:int>>"


class Responder(Protocol):
    """Answers a message with what a search found; ``None`` where nothing was asked for."""

    def answer(self, message: str, found: DataFrame | None) -> str: ...


class SummaryResponder:
    """The offline responder: greets, or says how many frames in which folders were found."""

    def answer(self, message: str, found: DataFrame | None) -> str:
        if found is None:
            return "Hello! Describe a scene and I will look for it."
        s = found.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("folder").cast("string"))), ", ").alias("f")).first()  # one row
        return f"Found {s['n']} frame{'' if s['n'] == 1 else 's'} in folders: {s['f']}"


class Translator:
    """A translation function behind a cache of ``ttl`` seconds; text passes through where there is none or it fails."""

    def __init__(self, translate: Callable[[str], str] | None = None, ttl: float = 86_400, capacity: int = 10_000, clock: Callable[[], float] = time.time):
        self.translate, self.clock, self.cache, self.known = translate, clock, TtlCache(ttl, capacity), {}

    def __call__(self, text: str) -> tuple[str, float]:
        """The translated text and its confidence; 0.1 for text that passed through."""
        if not text.strip():
            return text, 0.0
        if self.translate is None:
            return text, 0.1
        hit = self.cache.request(text, self.clock())
        if not hit or text not in self.known:
            try:
                self.known[text] = self.translate(text)
            except (OSError, RuntimeError, ValueError):  # an optional service: its failures pass the text through
                self.cache.entries.pop(text, None)
                return text, 0.1
            self.known = {k: self.known[k] for k in self.cache.entries if k in self.known}
        return self.known[text], 0.9


def choose_backend(available: dict[str, object]) -> str:
    """The container if there is one, else a remote index, else the frames in the session."""
    for name in BACKENDS:
        if available.get(name) is not None:
            return name
    raise ValueError("no index to search")


def remote_rows(spark: SparkSession, payload: str, limit: int, threshold: float = 0.0) -> DataFrame:
    """Result rows of a remote handle's JSON answer; a missing rank is the place in the list; the threshold comes last."""
    read = spark.createDataFrame([(payload,)], "j string").select(F.posexplode(F.from_json("j", _REMOTE)).alias("at", "r"))
    rows = read.select(
        F.col("r.metadata.folder_name").alias("folder"), F.col("r.metadata.frame_id").alias("frame_id"), F.col("r.metadata.image_name").alias("name"),
        F.col("r.metadata.file_path").alias("path"), F.col("r.similarity_score").alias("score"), F.coalesce("r.rank", F.col("at") + 1).alias("rank"),
    )
    return search.above(rows.orderBy("rank").limit(limit), threshold)


@dataclass
class SearchService:
    """Search over a frames table with pluggable encoder, translator, query expander and responder.

    ``container`` (frames of a container) and ``remote`` (a function of a
    vector and a limit that answers in JSON) are searched instead of
    ``frames`` where given, in that order.  Errors are raised, not swallowed
    into empty results.
    """

    frames: DataFrame | None
    encoder: encoders.Encoder = field(default_factory=encoders.HashingEncoder)
    translate: Callable[[str], tuple[str, float]] = field(default_factory=Translator)
    expand: Callable[[str], list[str]] = lambda text: [text]
    hooks: dict[str, list[Callable]] = field(default_factory=dict)
    docs: DataFrame | None = None
    metadata: DataFrame | None = None
    container: DataFrame | None = None
    remote: Callable[[list[float], int], str] | None = None
    cache: ResultCache | None = None
    responder: Responder = field(default_factory=SummaryResponder)
    strategy: str = "exact_ip"

    def on(self, event: str, hook: Callable) -> None:
        self.hooks.setdefault(event, []).append(hook)

    def _tell(self, event: str, *args) -> None:
        for hook in self.hooks.get(event, []):
            hook(*args)

    def backend(self) -> str:
        return choose_backend({"container": self.container, "remote": self.remote, "memory": self.frames})

    def table(self) -> DataFrame:
        """The frames of the chosen backend; a remote index has none here."""
        found = self.container if self.container is not None else self.frames
        if found is None:
            raise ValueError("the frames of a remote index are not in this session")
        return found

    def _nearest(self, vector: list[float], limit: int) -> DataFrame:
        if self.backend() == "remote":
            return remote_rows(SparkSession.active(), self.remote(vector, limit), limit)
        return search.VectorIndex(self.table(), self.strategy).search(vector, limit)

    def search(self, text: str, options: search.SearchOptions | None = None, **kw) -> DataFrame:
        """Text search: cache, understanding, mode, post-processing.  Without a cache it is one lazy plan."""
        o = options or search.SearchOptions(**kw)
        if not text.strip():
            raise ValueError("the query is blank")
        self._tell("search", text, o)
        if self.cache is None:
            return self._search(text, o)
        return self.cache.cached(("search", self.backend(), self.strategy, *o.cache_key(text)), lambda: self._search(text, o))

    def _search(self, text: str, o: search.SearchOptions) -> DataFrame:
        prompt, confidence = self.translate(text)
        prompt = prompt if confidence > 0.3 else text
        vectors = [encoders.encode_query(x, self.encoder) for x in self.expand(prompt)]
        if o.mode == "vector" or self.backend() == "remote":
            found = search.above(self._nearest(vectors[0], o.limit), o.similarity_threshold)
        elif o.mode == "semantic":  # every expansion on its own, first come first served
            found = search.above(fusion.rank_results(fusion.expanded_search(self.table(), vectors, o.limit).drop("rank"), o.limit), o.similarity_threshold)
        else:
            found = fusion.hybrid(self.table(), vectors[0], vectors, limit=o.limit, threshold=o.similarity_threshold)
        return self._post(found, text, o)

    def _needed(self, name: str) -> DataFrame:
        if (found := getattr(self, name)) is None:
            raise ValueError(f"this request needs the table {name!r}")
        return found

    def search_by_image(self, frame_id: int, options: search.SearchOptions | None = None, **kw) -> DataFrame:
        o = options or search.SearchOptions(**kw)
        return self._post(search.above(search.topk_by_example(self.table(), frame_id, o.limit), o.similarity_threshold), f"frame {frame_id}", o)

    def _post(self, found: DataFrame, text: str, o: search.SearchOptions) -> DataFrame:
        found = fusion.validate(found)
        if o.include_temporal_context and self.backend() != "remote":
            found = temporal.with_context(found, self.table(), o.temporal_window)
        return fusion.explain(found, text) if o.include_explanations else found

    def chat_search(self, message: str, limit: int = 10) -> tuple[str, DataFrame | None]:
        """An answer and the first results, in order of arrival; greetings are answered without a search."""
        if message.strip().lower() in T.GREETINGS:
            return self.responder.answer(message, None), None
        expansions = self.expand(message[:1000])[:3]
        if self.backend() == "remote":
            lists = [self._nearest(encoders.encode_query(x, self.encoder), 20) for x in expansions]
        else:
            lists = [fusion.hybrid(self.table(), encoders.encode_query(x, self.encoder), limit=20) for x in expansions]
        merged = fusion.merge_dedup(lists).orderBy("list_no", "rank").limit(limit)
        return self.responder.answer(message, merged), merged

    def chat(self, question: str, context: DataFrame | None = None) -> DataFrame:
        """One row: the answer, and the keys of the frames it speaks of.

        With ``context`` (frames that were selected) nothing is searched.
        """
        if context is not None:
            answer, found = self.responder.answer(question, context), context
        else:
            answer, found = self.chat_search(question)
        if found is None:
            return SparkSession.active().createDataFrame([(answer, [])], "answer string, frames array<string>")
        keys = found.agg(F.sort_array(F.collect_list(T.display_id(F.col("folder"), F.col("frame_id")))).alias("frames"))  # at most the limit
        return keys.select(F.lit(answer).alias("answer"), "frames")

    def translation(self, text: str) -> DataFrame:
        """One row: the text, its translation, the confidence and the language."""
        translated, confidence = self.translate(text)
        row = SparkSession.active().createDataFrame([(text, translated, confidence)], "original string, translated string, confidence double")
        return row.withColumn("language", T.detect_language(F.col("original")))

    def metadata_of(self, folder: str, image: str, level: str = "rich", relationships: bool = False) -> DataFrame:
        """The row of one image at a level of detail, with its neighbours in time and its similar frames if wanted."""
        rows = self._needed("metadata")
        one = rows.where((F.col("folder_name") == folder) & (F.col("image_name") == image))
        if one.isEmpty():
            raise KeyError(f"no metadata for {folder}/{image}")
        out = search.metadata_detail(one, level)
        if relationships:
            of = one.select("frame_id").first()["frame_id"]
            near = temporal.neighbours(self.table().where(F.col("folder").cast("string") == folder).select("folder", "frame_id")).where(F.col("frame_id") == of)
            like = search.similar_frames(self.table(), of).agg(F.array_agg("dst").alias("similar"))  # at most the limit
            out = out.join(near.select("frame_id", F.col("context").alias("neighbours")), "frame_id", "left").crossJoin(F.broadcast(like))  # one row each
        return out

    def semantic_search(self, docs: DataFrame, query: str, limit: int = 50, threshold: float = 0.5) -> DataFrame:
        """Tag scoring over ``folder, frame_id, tags, objects, description``."""
        scored = docs.withColumn("score", T.semantic_score(T.terms(F.lit(query)), F.col("tags"), F.col("objects"), F.col("description"), F.col("folder").cast("string")))
        return fusion.rank_results(scored.where(F.col("score") >= threshold), limit)

    def stats(self) -> DataFrame:
        """Frames per folder, and one row for all of them (``folder`` null)."""
        return self.table().rollup("folder").agg(F.count("*").alias("frames"), F.max(F.size("v")).alias("dimension"))

    def handle(self, kind: str, request: dict) -> DataFrame:
        """A validated request, formatted at its level of detail; failures raise with the reason."""
        if problem := validate_request(kind, request):
            raise ValueError(problem)
        level, limit = request.get("detail_level", "standard"), request.get("limit", 50)
        if kind == "search":
            flags = {k: request[k] for k in ("include_temporal_context", "include_explanations") if k in request}
            return search.detail(self.search(request["query"], limit=limit, mode=request.get("mode", "hybrid"), **flags), level)
        if kind == "image_search":
            return search.detail(self.search_by_image(int(request["image_name"]), limit=limit), level)
        if kind == "semantic_search":
            found = self.semantic_search(self._needed("docs"), request["semantic_query"], limit, request.get("confidence_threshold", 0.5))
            return search.detail(found, request.get("detail_level", "rich"))
        if kind == "metadata":
            return self.metadata_of(request["folder_name"], request["image_name"], request.get("detail_level", "rich"), request.get("include_relationships", False))
        if kind == "translate":
            return self.translation(request["text"])
        if kind == "chat":
            return self.chat(request["question"], request.get("context_frames"))
        return self.stats()


def quick_search(files: DataFrame, text: str, limit: int = 10, encode: str = "content", make: Callable[[], encoders.Encoder] = encoders.HashingEncoder) -> DataFrame:
    """Encodes listed files and searches them once; nothing is stored."""
    frames = encoders.with_embeddings(files, encode, make)
    return search.topk(frames, encoders.encode_query(text, make()), limit)


def invalid_requests(requests: DataFrame) -> DataFrame:
    """``validate_request`` for a table of requests ``kind, body`` (JSON), as one expression: adds ``problem``."""
    body = F.from_json("body", "map<string,string>")
    text = lambda name: F.element_at(body, F.lit(name))
    known = F.col("kind").isin(*REQUESTS)
    problem = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown request '"), F.coalesce("kind", F.lit("")), F.lit("'")))
    for kind, names in REQUESTS.items():
        for name in names:
            here = F.col("kind") == kind
            problem = problem.when(here & (F.trim(F.coalesce(text(name), F.lit(""))) == ""), f"missing field {name!r}")
            problem = problem.when(here & (F.length(text(name)) > MAX_TEXT), f"{name!r} is longer than {MAX_TEXT}")
    limit = F.coalesce(text("limit"), F.lit("50")).try_cast("int")
    problem = problem.when(limit.isNull() | (limit <= 0) | (limit > 1000), "limit must be in 1..1000")
    problem = problem.when(~F.coalesce(text("mode"), F.lit("hybrid")).isin(*search.MODES, *search.MODE_NAMES), f"mode must be one of {search.MODES}")
    return requests.withColumn("problem", problem.when(~F.coalesce(text("detail_level"), F.lit("standard")).isin(*LEVELS), "unknown detail_level"))


def register_udtf(spark) -> None:
    """``SELECT * FROM parse_frame_refs('a:1, b:2')``: frame references in SQL, at most five."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="folder string, frame string, problem string")
    class ParseFrameRefs:
        def eval(self, refs: str):
            for ref in [r.strip() for r in (refs or "").split(",") if r.strip()][:5]:
                folder, colon, frame = ref.partition(":")
                yield (folder, frame.strip(), None) if colon else (None, None, f"not a folder:frame reference: {ref}")

    spark.udtf.register("parse_frame_refs", ParseFrameRefs)


@dataclass
class AgentTools:
    """What an agent may call, each a table: search, analyse, status, chat."""

    service: SearchService

    def search_frames(self, query: str, limit: int = 10) -> DataFrame:
        found = self.service.search(query, limit=limit, include_temporal_context=False)
        return found.select("rank", T.display_id(F.col("folder"), F.col("frame_id")).alias("frame"), F.format_string("%.3f", "score").alias("score"))

    def analyse_frames(self, refs: str) -> DataFrame:
        """The referenced frames with their metadata; references that are malformed or unknown say so."""
        wanted = SparkSession.active().createDataFrame([(refs,)], "refs string").select(F.inline(T.frame_references(F.col("refs"))))
        known = self.service.table().select(F.col("folder").cast("string").alias("f"), F.col("frame_id").cast("string").alias("i"), F.size("v").alias("dimension"))
        both = wanted.join(known, (F.col("folder") == F.col("f")) & (F.col("frame") == F.col("i")), "left")
        problem = F.coalesce("problem", F.when(F.col("i").isNull(), F.concat(F.lit("unknown frame: "), T.display_id(F.col("folder"), F.col("frame")))))
        return both.select("folder", "frame", "dimension", problem.alias("problem"))

    def status(self) -> DataFrame:
        return stats.index_stats(self.service.table()).withColumn("backend", F.lit(self.service.backend()))

    def chat(self, message: str, selected: str | None = None) -> DataFrame:
        """An answer about the selected frames (a list in any form), or about what a search finds."""
        refs = SparkSession.active().createDataFrame([(selected,)], "refs string").select(F.inline(T.frame_references(F.col("refs")))).where("problem is null")
        if refs.isEmpty():
            return self.service.chat(message)
        chosen = refs.select(F.col("folder").alias("cf"), F.col("frame").alias("ci"))
        frames = self.service.table().join(F.broadcast(chosen), (F.col("folder").cast("string") == F.col("cf")) & (F.col("frame_id").cast("string") == F.col("ci")), "left_semi")  # at most five rows
        return self.service.chat(message, frames)
