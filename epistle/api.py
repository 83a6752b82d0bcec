"""The archive's tools: checked parameters in, plain dictionaries out. Plans are built lazily and each tool
brings at most a page of rows to the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistle.functions import sqlsem
from epistle.operators import analytics as A
from epistle.operators import filters as P
from epistle.operators import fulltext as S
from epistle.operators import threads as T
from epistle.operators import vectors as V
from epistle.plans.fts_query import FtsSyntaxError
from epistle.schema import REGISTRY, with_defaults

MOST = 50
_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")
_UUID4 = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)


class ParameterError(ValueError):
    """A parameter is missing, of the wrong type or out of range."""


def _check(name: str, value, kind: type, *, required: bool = False, among=None, pattern: re.Pattern | None = None, low=None, high=None):
    if value is None:
        if required:
            raise ParameterError(f"{name} is required")
        return None
    if type(value) is not kind:  # strict: "5" is no number and True no integer
        raise ParameterError(f"{name} must be {kind.__name__}")
    if among and value not in among:
        raise ParameterError(f"{name} must be one of {', '.join(among)}")
    if pattern and not pattern.fullmatch(value):
        raise ParameterError(f"{name} is malformed")
    if low is not None and value < low or high is not None and value > high:
        raise ParameterError(f"{name} is out of range")
    return value


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """Tools over a message table, optionally with its vector table and project registry.

    rank_order "best_first" pages keyword hits from the best; "worst_first" is what older clients expect. Ids are UUIDs unless
    check_ids is false. search answers keyword queries, from a stored index for instance; by default the texts are searched. encode turns a text into a vector; without it semantic queries fail with an error."""

    def __init__(self, messages: DataFrame, vectors: DataFrame | None = None, registry: DataFrame | None = None, encode=None, rank_order: str = "best_first", check_ids: bool = True, search=None):
        self.messages = with_defaults(messages)
        self.vectors = V.vector_table(self.messages) if vectors is None else vectors
        self.registry = messages.sparkSession.createDataFrame([], REGISTRY) if registry is None else registry
        self.search = search or (lambda query: S.search(self.messages, query))
        self.encode, self.rank_order, self.check_ids = encode, rank_order, check_ids

    def query_email_database(self, semantic_query=None, exact_keywords=None, category_filter=None, project_filter=None, date_from=None, date_to=None, from_address=None, from_name=None,
                             to_address=None, is_outbound=None, has_attachments=None, limit=10, include_full_thread=False, sort_by=None, sort_order=None, count_only=False, fields=None,
                             snippet_only=False, snippet_length=32, cursor=None, tag_match="substring", chronological=False) -> dict:
        """Search by meaning, by words, by both, or by fields alone."""
        for name, value in dict(semantic_query=semantic_query, exact_keywords=exact_keywords, category_filter=category_filter, project_filter=project_filter, date_from=date_from, date_to=date_to,
                                from_address=from_address, from_name=from_name, to_address=to_address, cursor=cursor).items():
            _check(name, value, str)
        for name, value in dict(is_outbound=is_outbound, has_attachments=has_attachments, include_full_thread=include_full_thread, count_only=count_only, snippet_only=snippet_only).items():
            _check(name, value, bool)
        _check("limit", limit, int)
        _check("sort_by", sort_by, str, among=("timestamp", "relevance"))
        _check("sort_order", sort_order, str, among=("asc", "desc"))
        _check("snippet_length", snippet_length, int, low=1, high=64)
        limit, ascending = max(1, min(limit, MOST)), sort_order == "asc"
        keywords = (exact_keywords or "").strip()
        wanted = P.where(category=category_filter, project=project_filter, date_from=date_from, date_to=date_to, from_address=from_address, from_name=from_name, to_address=to_address,
                         is_outbound=is_outbound, has_attachments=has_attachments, cursor=cursor, ascending=ascending, tag_match=tag_match, chronological=chronological)
        try:
            hits = self.search(keywords) if keywords else None
        except FtsSyntaxError as error:
            return {"error": str(error), "results": []}
        rows = self.messages.where(wanted)
        if count_only:
            return {"count": (rows if hits is None else rows.join(hits, "id", "left_semi")).count()}
        if semantic_query and self.encode is None:
            return {"error": "no encoder", "results": []}
        listed = P.columns(fields)
        if semantic_query:
            near = V.knn(self.vectors.join(rows.select("id"), "id", "left_semi"), self.encode(semantic_query), max(limit + 1, V.POOL))
            if hits is None:
                ranked, kind, order = near.withColumnRenamed("distance", "relevance_score"), "distance", [F.col("relevance_score"), F.col("id")]
            else:
                ranked, kind, order = V.fuse(near, hits.join(rows.select("id"), "id", "left_semi"), limit + 1).withColumnRenamed("score", "relevance_score"), "rrf", [F.desc("relevance_score"), F.col("id")]
        elif hits is not None:
            found = rows.select("id", F.col("ts_raw").alias("_ts")).join(hits, "id")
            if sort_by == "timestamp":
                order = [F.asc("_ts"), F.asc("id")] if ascending else [F.desc("_ts"), F.desc("id")]
            else:
                best = (self.rank_order == "best_first") != (sort_by == "relevance" and ascending)
                order = [F.asc("rank") if best else F.desc("rank"), F.asc("id")]
            ranked, kind = S.relevance(found.orderBy(*order).limit(limit + 1)).withColumnRenamed("relevance", "relevance_score"), "page"
        else:
            order = [F.asc("_ts"), F.asc("id")] if ascending else [F.desc("_ts"), F.desc("id")]
            ranked, kind = rows.select("id", F.col("ts_raw").alias("_ts")).orderBy(*order).limit(limit + 1), None
        scores = [c for c in ("relevance_score", "method", "_ts", "rank") if c in ranked.columns]
        page = rows.join(F.broadcast(ranked), "id")  # at most limit + 1 rows
        shown = page.select("id", *[c for f, c in zip(P.names(fields), listed) if f != "id"], F.col("ts_raw").alias("_key"), F.col("thread_id").alias("_thread"), P.body_text().alias("_body"), P.prefix_snippet(500).alias("_snippet"), *scores)
        if hits is not None and snippet_only:
            shown = S.snippets(shown.withColumn("body_text", F.col("_body")), keywords, snippet_length)
        found = _rows(shown.orderBy(*order))
        more, found = len(found) > limit, found[:limit]
        result: dict = {"results": [], "next_cursor": None, "has_more": more}
        if more:
            result["next_cursor"] = sqlsem.encode_cursor(found[-1]["_key"], found[-1]["id"])
        if include_full_thread and found:
            threads = [r["_thread"] for r in found if r["_thread"]]
            result["threads"] = {r["thread_id"]: r["messages"] for r in _rows(T.expand(self.messages.where(F.col("thread_id").isin(threads)).select("thread_id"), self.messages))}
        for r in found:
            snippet = r.get("snippet") or r["_snippet"]
            row = {k: v for k, v in r.items() if k[0] != "_" and k not in ("rank", "snippet")} | {"snippet": snippet}
            result["results"].append(({"id": r["id"], "snippet": snippet} | ({"relevance_score": r["relevance_score"]} if "relevance_score" in r else {}) if snippet_only else row) | ({"score_kind": kind} if kind else {}))
        return result

    def get_email_by_id(self, email_id=None) -> dict | None:
        _check("email_id", email_id, str if self.check_ids else type(email_id), required=True, pattern=_UUID4 if self.check_ids else None)
        found = _rows(self.messages.where(F.col("id") == email_id).drop(*P.HIDDEN).withColumn("body_text", P.body_text()).limit(1))
        return found[0] if found else None

    def get_thread_by_id(self, thread_id=None) -> dict | None:
        """A whole thread, quoted messages too."""
        _check("thread_id", thread_id, str, required=True, pattern=re.compile("thread-.*"))
        rows = T.conversation(self.messages, thread_id)
        about = _rows(T.summary(rows))
        if not about:
            return None
        a = about[0]
        shown = rows.select("id", "subject", "ts_raw", "from_address", "from_name", "recipients", "source", P.body_text().alias("body_text"))
        return {"thread_id": thread_id, "subject": a["subject"], "message_count": a["message_count"], "participants": a["participants"], "attachment_count": a["attachment_count"],
                "date_range": [a["first_message"], a["last_message"]], "messages": _rows(shown)}

    def get_project_context(self, project_name=None, limit=10) -> dict | None:
        _check("project_name", project_name, str, required=True)
        _check("limit", limit, int, low=1, high=MOST)
        found = _rows(A.list_projects(A.find_project(self.registry, project_name), 1))
        return {"project": found[0], "emails": _rows(A.project_messages(self.messages, found[0]["name"], limit))} if found else None

    def list_projects(self, limit=20) -> list[dict]:
        _check("limit", limit, int, low=1, high=100)
        return _rows(A.list_projects(self.registry, limit))

    def get_mention_timeline(self, keyword=None, semantic_query=None, granularity="year", date_from=None, date_to=None, from_address=None, is_outbound=None) -> dict:
        _check("keyword", keyword, str, required=True)
        _check("granularity", granularity, str, among=("year", "month", "quarter"))
        try:
            rows = _rows(A.mention_timeline(self.messages, keyword, granularity, P.where(date_from=date_from, date_to=date_to, from_address=from_address, is_outbound=is_outbound, include_quoted=True)))
        except FtsSyntaxError as error:
            return {"error": str(error)}
        ends = [r for r in rows if r["first_occurrence"]]
        return {"keyword": keyword, "total_matches": sum(r["n"] for r in rows), "first_occurrence": min((r["first_occurrence"] for r in ends), default=None),
                "last_occurrence": max((r["last_occurrence"] for r in ends), default=None), "timeline": {r["period"]: r["n"] for r in sorted(rows, key=lambda r: r["period"] or "") if r["period"]}}

    def get_contact_profile(self, name=None, email_address=None, limit=10, include_timeline=True) -> dict | None:
        _check("email_address", email_address, str, pattern=_EMAIL)
        _check("limit", limit, int, low=1, high=MOST)
        found = _rows(A.contact_profile(self.messages, name, email_address))
        if not found:
            return None
        contact = found[0]
        if include_timeline:
            contact["timeline"] = {r["year"]: r["n"] for r in _rows(A.contact_histogram(self.messages, name, email_address))}
        return {"contact": contact, "sample_emails": _rows(A.contact_samples(self.messages, name, email_address, limit))}

    def get_thread_arc(self, thread_id=None, mode="summary", max_messages=20) -> dict | None:
        _check("thread_id", thread_id, str, required=True)
        _check("mode", mode, str, among=("summary", "full"))
        _check("max_messages", max_messages, int, low=1)
        found = _rows(T.arc(self.messages, thread_id, mode, max_messages))
        if not found:
            return None
        people = sorted({r["from_address"] for r in found} | {a for r in found for a in r["recipients"] or []})
        total = self.messages.where(T.of_thread(self.messages, thread_id) & P.not_quoted()).count()
        return {"thread_id": thread_id, "subject": found[0]["subject"], "message_count": len(found), "total_messages": total, "participants": people,
                "date_range": [found[0]["ts_raw"], found[-1]["ts_raw"]], "messages": [{k: v for k, v in r.items() if k != "recipients"} for r in found]}

    def list_threads(self, sort_by="message_count", sort_order="desc", limit=10) -> dict:
        found = _rows(T.list_threads(self.messages, sort_by, sort_order, limit))
        return {"threads": found, "count": len(found)}

    def search_emails(self, query=None, date_from=None, date_to=None, from_address=None, to_address=None, has_attachments=None, folder=None, limit=20, similar_to_email_id=None) -> dict:
        """The older search: by words or by a stored message; * or nothing lists everything."""
        wanted = P.where(date_from=date_from, date_to=date_to, from_address=from_address, to_address=to_address, has_attachments=has_attachments, folder=folder)
        rows = self.messages.where(wanted)
        shown = ("id", "subject", "from_address", "ts_raw", P.prefix_snippet(500).alias("snippet"))
        if similar_to_email_id is not None:
            near = V.similar_to(self.vectors.where(V.prefilter()).join(rows.select("id"), "id", "left_semi").unionByName(self.vectors.where(F.col("id") == similar_to_email_id)).dropDuplicates(["id"]), similar_to_email_id, limit)
            found = _rows(rows.join(F.broadcast(near), "id").orderBy("distance", "id").select(*shown, "distance"))  # at most limit rows
            return {"results": found} if found else {"results": [], "reason": "the message has no vector or no neighbours"}
        if query and query.strip() not in ("", "*"):
            rows = rows.join(self.search(query).select("id"), "id", "left_semi")
        return {"results": _rows(rows.orderBy(F.desc("ts_raw"), F.desc("id")).limit(limit).select(*shown))}

    def find_recipient_emails(self, email_address=None, limit=50) -> list[dict]:
        _check("email_address", email_address, str, required=True)
        return _rows(A.find_recipient(self.messages, email_address, limit).select("id", "subject", "from_address", "recipients", "ts_raw"))

    def read_body(self, uri: str) -> str | None:
        """The text behind email://<id>/body."""
        m = re.fullmatch(r"email://([^/]+)/body", uri)
        if not m:
            raise ParameterError(f"unknown resource {uri}")
        found = self.messages.where(F.col("id").cast("string") == m[1]).select(F.coalesce("body_markdown", "body_text").alias("b")).limit(1).collect()
        return found[0].b if found else None


#: The tools that clients may call.
NAMES = ("query_email_database", "get_project_context", "get_email_by_id", "get_thread_by_id", "list_projects", "get_mention_timeline", "get_contact_profile", "get_thread_arc", "list_threads")
