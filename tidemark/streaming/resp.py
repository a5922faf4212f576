"""A key-value target that speaks RESP, the protocol of the common cache servers, over a socket."""

from __future__ import annotations

import socket

from ..errors import RetryableSinkError, SinkError
from .sinks import KeyValue

#: Error replies that may pass: the server starts, changes its role or is busy. Fixed values.
PASSING = ("LOADING", "READONLY", "MASTERDOWN", "CLUSTERDOWN", "TRYAGAIN", "BUSY", "OOM")


class RespKeyValue(KeyValue):
    """Mutations of a batch go as one transaction (MULTI to EXEC), so that all are seen or none.

    A lost connection and replies of PASSING are retryable, and the connection is made anew; all other errors are final.
    """

    def __init__(self, host: str, port: int, password: str | None = None, timeout_s: float = 5.0):
        self.address, self.password, self.timeout_s, self.stream = (host, port), password, timeout_s, None

    def apply(self, mutations: list[tuple[str, str, str | None, int | None]]) -> None:
        if not mutations:
            return
        try:
            if self.stream is None:
                self.stream = socket.create_connection(self.address, self.timeout_s).makefile("rwb")
                if self.password is not None:
                    self._ask([("AUTH", self.password)])
            self._ask([("MULTI",), *[self._command(*m) for m in mutations], ("EXEC",)])
        except RetryableSinkError:
            self.close()
            raise
        except OSError as e:
            self.close()
            raise RetryableSinkError(f"the connection to {self.address} is lost: {e}") from e

    @staticmethod
    def _command(kind: str, key: str, value: str | None, ttl: int | None) -> tuple[str, ...]:
        if kind == "del":
            return ("DEL", key)
        return ("SET", key, value or "", *(("EX", str(ttl)) if ttl is not None else ()))

    def _ask(self, commands: list[tuple[str, ...]]) -> None:
        for c in commands:
            self.stream.write(b"*%d\r\n" % len(c) + b"".join(b"$%d\r\n%s\r\n" % (len(x.encode()), x.encode()) for x in c))
        self.stream.flush()
        # All replies are read before any is judged, so that the connection stays in step.
        errors = [x for x in [e for _ in commands for e in self._reply()] if x]
        if errors:
            passing = all(e.split(" ")[0] in PASSING or e.startswith("EXECABORT") for e in errors) and any(e.split(" ")[0] in PASSING for e in errors)
            raise (RetryableSinkError if passing else SinkError)(errors[0])

    def _reply(self) -> list[str]:
        """The errors in a reply."""
        line = self.stream.readline()
        if not line.endswith(b"\r\n"):
            raise OSError("the server has closed it")
        kind, rest = line[:1], line[1:-2]
        if kind == b"-":
            return [rest.decode("utf-8", "replace")]
        if kind == b"$" and int(rest) >= 0:
            self.stream.read(int(rest) + 2)
        if kind == b"*" and int(rest) >= 0:
            return [e for _ in range(int(rest)) for e in self._reply()]
        return []

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
