"""Line-delimited JSON-RPC over stdio for the tools."""

from __future__ import annotations

import inspect
import json
import sys

from epistle.api import NAMES, ParameterError, Tools

PROTOCOL = "2024-11-05"


def _schema(f) -> dict:
    return {"type": "object", "properties": {n: {} for n in inspect.signature(f).parameters}}


def handle(tools: Tools, request: dict) -> dict | None:
    """The response to one request; none to a notification."""
    method, params, id_ = request.get("method", ""), request.get("params") or {}, request.get("id")
    if method.startswith("notifications/") or method == "initialized":
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "epistle", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": (getattr(tools, n).__doc__ or n).strip(), "inputSchema": _schema(getattr(tools, n))} for n in NAMES]}
        elif method == "tools/call":
            if params.get("name") not in NAMES:
                return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"no tool {params.get('name')!r}"}}
            try:
                answer, failed = getattr(tools, params["name"])(**(params.get("arguments") or {})), False
            except (ParameterError, TypeError) as error:
                answer, failed = {"error": str(error)}, True
            failed = failed or isinstance(answer, dict) and "error" in answer
            result = {"content": [{"type": "text", "text": json.dumps(answer, default=str)}], "isError": failed}
        elif method == "resources/list":
            result = {"resources": [{"uri": "email://{id}/body", "name": "body", "mimeType": "text/markdown"}]}
        elif method == "resources/read":
            body = tools.read_body(params.get("uri", ""))
            if body is None:
                return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": "no such message"}}
            result = {"contents": [{"uri": params["uri"], "mimeType": "text/markdown", "text": body}]}
        elif method == "prompts/list":
            result = {"prompts": []}
        else:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"no method {method!r}"}}
    except Exception as error:  # noqa: BLE001  the client gets every fault as an answer
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32603, "message": str(error)}}
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def serve(tools: Tools, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            try:
                answer = handle(tools, json.loads(line))
            except json.JSONDecodeError as error:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
            if answer is not None:
                print(json.dumps(answer), file=out, flush=True)
