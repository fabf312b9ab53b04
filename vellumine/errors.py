"""The error model: a kind, a status and a message."""

from __future__ import annotations


class EngineError(Exception):
    error, status = "InternalError", 500

    def as_dict(self) -> dict:
        return {"error": self.error, "message": str(self), "status": self.status}


class InvalidRequest(EngineError):
    error, status = "InvalidRequest", 400


class NotFound(EngineError):
    error, status = "NotFound", 404


class RecordNotFound(EngineError):
    error, status = "RecordNotFound", 404


class AlreadyExists(EngineError):
    error, status = "AlreadyExists", 409


class MethodNotImplemented(EngineError):
    error, status = "MethodNotImplemented", 501


class ServiceUnavailable(EngineError):
    error, status = "ServiceUnavailable", 503


class UpstreamFailure(EngineError):
    error, status = "UpstreamFailure", 502
