"""Errors of the engine; each carries a code for callers that must tell them apart."""

# The codes callers know.
CODES = ("EMPTY_CONTENT", "SENSITIVE_CONTENT", "STORE_CLOSED", "STORE_WRITE_FAILED", "STORE_READ_FAILED", "NOT_FOUND", "INTERNAL")


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message)
        self.code = code
