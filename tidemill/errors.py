"""Errors that callers may tell apart: each has a stable code, an HTTP status and whether a retry may help."""

from __future__ import annotations


class EngineError(Exception):
    code, status, retryable = "INTERNAL_ERROR", 500, False

    def __init__(self, message: str = "", *, details: dict | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.details, self.retry_after = details or {}, retry_after

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "details": self.details}}


def _kind(name: str, code: str, status: int, retryable: bool) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "status": status, "retryable": retryable, "__module__": __name__})


# Codes and statuses that clients rely on.
ValidationError = _kind("ValidationError", "VALIDATION_ERROR", 422, False)
AuthInvalidKey = _kind("AuthInvalidKey", "AUTH_INVALID_KEY", 401, False)
RateLimited = _kind("RateLimited", "RATE_LIMITED", 429, True)
LLMSchemaViolation = _kind("LLMSchemaViolation", "LLM_SCHEMA_VIOLATION", 502, True)
LLMProviderExhausted = _kind("LLMProviderExhausted", "LLM_PROVIDER_EXHAUSTED", 503, True)
RetrievalBackendUnavailable = _kind("RetrievalBackendUnavailable", "RETRIEVAL_BACKEND_UNAVAILABLE", 503, True)
GraphBackendUnavailable = _kind("GraphBackendUnavailable", "GRAPH_BACKEND_UNAVAILABLE", 503, True)
BudgetExceeded = _kind("BudgetExceeded", "BUDGET_EXCEEDED", 200, False)
NotFound = _kind("NotFound", "NOT_FOUND", 404, False)
ConflictError = _kind("ConflictError", "CONFLICT", 409, False)
JobTimeout = _kind("JobTimeout", "JOB_TIMEOUT", 504, True)
InternalError = _kind("InternalError", "INTERNAL_ERROR", 500, False)


def envelope_of(error: BaseException) -> dict:
    """What a caller may see of an error: foreign exceptions show no detail."""
    return error.envelope() if isinstance(error, EngineError) else InternalError("internal error").envelope()
