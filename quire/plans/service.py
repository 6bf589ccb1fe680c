"""A JSON-RPC façade over the document queries: six tools, one line a message."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, functions as F

from quire.operators import chunks as C, search as Q
from quire.operators.stats import document_statistics

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 0}


def _tool(name: str, says: str, need: tuple[str, ...] = (), **more) -> dict:
    return {"name": name, "description": says, "inputSchema": {"type": "object", "properties": {"path": _TEXT, **more}, "required": ["path", *need]}}


TOOLS = [
    _tool("open_document", "Size and outline of a document."),
    _tool("get_outline", "Its outline: a line a section, with address, tokens and pages."),
    _tool("read_section", "A section by its address, with or without subsections.", ("section",), section=_TEXT, includeSubsections={"type": "boolean"}),
    _tool("search_document", "Its best chunks for some words.", ("query",), query=_TEXT, limit=_NUMBER),
    _tool("read_chunk", "A chunk by its number, with neighbours.", ("chunk",), chunk=_NUMBER, neighbours=_NUMBER),
    _tool("export_document", "Write a document's formats; tells the paths.", ("folder",), folder=_TEXT),
]


class Service:
    """``convert(path)`` gives a document's blocks; ``version(path)`` what tells a changed file."""

    def __init__(self, convert: Callable[[str], DataFrame], version: Callable[[str], object] = lambda path: None, options: C.Options = C.Options()):
        self.convert, self.version, self.options = convert, version, options
        self._kept: dict[str, tuple[object, DataFrame, DataFrame]] = {}

    def entry(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Blocks and chunks, converted once for each version of a path."""
        now = self.version(path)
        if path in self._kept and self._kept[path][0] == now:
            return self._kept[path][1:]
        self.forget(path)
        blocks = self.convert(path).persist()
        chunked = C.chunks(blocks, self.options).persist()
        self._kept[path] = (now, blocks, chunked)
        return blocks, chunked

    def forget(self, path: str) -> None:
        for frame in self._kept.pop(path, (None,))[1:]:
            frame.unpersist()

    # what each tool answers: texts of bounded size, by the tool's own limits

    def outline(self, chunked: DataFrame) -> str:
        o = C.outline(chunked)
        return "\n".join(r["line"] for r in o.select("first_chunk", C.outline_line(o).alias("line")).orderBy("first_chunk").collect())

    def _shown(self, chunked: DataFrame) -> str:
        rows = chunked.orderBy("chunk_id").select("chunk_id", "section_id", C.context(F.col("path"), F.col("part"), F.col("part_count"), F.col("text")).alias("t")).collect()
        return "\n\n".join(f"[chunk {r['chunk_id']} · section {r['section_id']}]\n{r['t']}" for r in rows)

    def call(self, name: str, a: dict) -> str:
        if name not in {t["name"] for t in TOOLS}:
            raise ValueError(f"no such tool: {name}")
        blocks, chunked = self.entry(a["path"])
        if name == "open_document":
            began = time.monotonic()
            s = document_statistics(blocks).first().asDict()
            return f"{s['pages']} pages, {s['words']:,} words, {s['characters']:,} characters, about {s['tokens']:,} tokens, {s['tables']} tables ({s['uncertain_tables']} unverified), read in {time.monotonic() - began:.1f} s\n\n{self.outline(chunked)}"
        if name == "get_outline":
            return self.outline(chunked)
        if name == "read_section":
            return self._shown(Q.section(chunked, a["section"], a.get("includeSubsections", True))) or f"No section {a['section']}."
        if name == "search_document":
            rows = Q.search(chunked, a["query"], a.get("limit", 8)).select("chunk_id", "section_id", "score", Q.excerpt(F.col("text")).alias("t")).collect()
            return "\n\n".join(f"[chunk {r['chunk_id']} · section {r['section_id']} · {r['score']:.2f}]\n{r['t']}" for r in rows) or "Nothing found."
        if name == "read_chunk":
            return self._shown(Q.around(chunked, a["chunk"], a.get("neighbours", 0))) or f"No chunk {a['chunk']}."
        from quire.sources import sinks

        base = a["path"].rstrip("/").rsplit("/", 1)[-1]
        key = blocks.schema["doc_id"].dataType
        names = blocks.select(F.col("doc_id").cast(key)).distinct().withColumn("filename", F.lit(base))
        frames = {
            "markdown": sinks.document_markdown(blocks), "json": sinks.document_json(blocks, documents=self._documents(blocks, base)),
            "chunks": chunked.select("doc_id", "chunk_id", sinks.chunk_json(chunked).alias("json")), "outline": sinks.outline_json(C.outline(chunked)),
        }
        written = sinks.export(frames, a["folder"], names=names)
        stem = base.rsplit(".", 1)[0] if base.rfind(".") > 0 else base
        return "\n".join(p.replace("*", stem) for p in written.values())

    def _documents(self, blocks: DataFrame, filename: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return blocks.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages")).select("doc_id", F.lit(filename).alias("filename"), "pages", none.alias("sha256"), F.lit("fast").alias("tier"), none.alias("model"), F.lit("1").alias("app_version"))

    def handle(self, line: str) -> str | None:
        """The answer to a message, or None to a notification."""
        try:
            message = json.loads(line)
        except ValueError:
            return self._reply(None, error={"code": -32700, "message": "not JSON"})
        if "id" not in message:
            return None
        ident, method, params = message["id"], message.get("method"), message.get("params") or {}
        if method == "initialize":
            return self._reply(ident, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quire", "version": "1"}})
        if method == "ping":
            return self._reply(ident, {})
        if method == "tools/list":
            return self._reply(ident, {"tools": TOOLS})
        if method != "tools/call":
            return self._reply(ident, error={"code": -32601, "message": f"no such method: {method}"})
        try:
            text, failed = self.call(params.get("name"), params.get("arguments") or {}), False
        except Exception as e:  # a tool's failure is an answer, not the server's end
            text, failed = str(e), True
        return self._reply(ident, {"content": [{"type": "text", "text": text}], "isError": failed})

    @staticmethod
    def _reply(ident, result=None, error=None) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": ident} | ({"error": error} if error else {"result": result}), ensure_ascii=False)

    def run(self, source: TextIO = sys.stdin, to: TextIO = sys.stdout) -> None:
        for line in source:
            if line.strip() and (answer := self.handle(line)) is not None:
                print(answer, file=to, flush=True)
