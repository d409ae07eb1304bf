"""Errors with the closed set of codes that callers may rely on, and their envelopes."""

from __future__ import annotations

import json

#: Each code with its HTTP status.
CODES = {
    "vault_not_found": 404, "not_found": 404, "invalid_input": 400, "invalid_path": 400, "invalid_body": 400, "invalid_query": 400, "unsupported_media_type": 415, "patch_no_match": 409,
    "patch_ambiguous": 409, "folder_not_empty": 409, "already_exists": 409, "embedder_failed": 502, "extraction_failed": 422, "internal": 500,
}


class VaultError(Exception):
    code = "internal"

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.code)
        self.details = details


class InvalidInput(VaultError):
    code = "invalid_input"


class InvalidPath(InvalidInput):
    code = "invalid_path"


class InvalidBody(InvalidInput):
    code = "invalid_body"


class InvalidQuery(InvalidInput):
    code = "invalid_query"


class UnsupportedMediaType(VaultError):
    code = "unsupported_media_type"


class VaultNotFound(VaultError):
    code = "vault_not_found"


class NotFound(VaultError):
    code = "not_found"


class PatchNoMatch(VaultError):
    code = "patch_no_match"


class PatchAmbiguous(VaultError):
    code = "patch_ambiguous"


class FolderNotEmpty(VaultError):
    code = "folder_not_empty"


class AlreadyExists(VaultError):
    code = "already_exists"


class EmbedderFailed(VaultError):
    code = "embedder_failed"


class ExtractionFailed(VaultError):
    code = "extraction_failed"


class DimensionMismatch(VaultError):
    def __init__(self, stored: int, wanted: int):
        super().__init__(f"stored vectors have {stored} numbers, not {wanted}", stored=stored, wanted=wanted)


class PipelineTooNew(VaultError):
    def __init__(self, stored: int, own: int):
        super().__init__(f"tables were written by pipeline {stored}, this is {own}", stored=stored, own=own)


def envelope(error: BaseException, request_id: str | None = None) -> tuple[int, dict]:
    """(HTTP status, body) of an error. What is not ours is internal, and its message is kept back."""
    if not isinstance(error, VaultError) or error.code == "internal":
        inner: dict = {"code": "internal", "message": "internal server error"}
        details = {"requestId": request_id} if request_id else {}
    else:
        inner, details = {"code": error.code, "message": str(error)}, error.details
    if details and inner["code"] != "embedder_failed":
        inner["details"] = details
    return CODES[inner["code"]], {"error": inner}


def tool_error(error: BaseException) -> dict:
    """A failed tool call as its caller sees it."""
    _, body = envelope(error)
    return {"isError": True, "content": [{"type": "text", "text": json.dumps(body["error"], ensure_ascii=False)}]}
