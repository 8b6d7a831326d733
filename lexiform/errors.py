"""Errors with stable codes and structured details."""

from __future__ import annotations


class LexiformError(Exception):
    code = "ERROR"

    def __init__(self, message: str, **details) -> None:
        super().__init__(message)
        self.details = details

    def report(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "details": {k: v if isinstance(v, (str, int, float, bool, list, dict, type(None))) else repr(v) for k, v in self.details.items()}}}


class ArtifactNotFound(LexiformError):
    code = "ARTIFACT_NOT_FOUND"


class ArtifactHashMismatch(LexiformError, ValueError):
    code = "ARTIFACT_HASH_MISMATCH"


class UncertifiedTokenizer(LexiformError, ValueError):
    code = "UNCERTIFIED_TOKENIZER"


class BackendUnavailable(LexiformError):
    code = "BACKEND_UNAVAILABLE"


class BackendExecutionFault(LexiformError):
    code = "BACKEND_EXECUTION_FAULT"


class StoreCorrupt(LexiformError):
    code = "STORE_CORRUPT"


class StoreFormatUnsupported(LexiformError):
    code = "STORE_FORMAT_UNSUPPORTED"


class SessionStateMismatch(LexiformError):
    code = "SESSION_STATE_MISMATCH"


class SessionRevisionConflict(LexiformError):
    code = "SESSION_REVISION_CONFLICT"


class ConfigInvalid(LexiformError, ValueError):
    code = "CONFIG_INVALID"


class UnsupportedConfig(LexiformError, ValueError):
    code = "UNSUPPORTED_CONFIG"


class RegistryInvalid(LexiformError, ValueError):
    code = "REGISTRY_INVALID"
