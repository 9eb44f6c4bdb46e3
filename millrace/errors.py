"""Errors by what went wrong; each class has the exit code of the command line."""


class CaptureError(Exception):
    exit_code = 1
    prefix = ""

    def __str__(self) -> str:
        return f"{self.prefix}: {super().__str__()}" if self.prefix else super().__str__()


class ConfigError(CaptureError):
    exit_code, prefix = 1, "Configuration error"


class ConnectionFailed(CaptureError):
    exit_code, prefix = 2, "Connection error"


class InputOutputError(CaptureError):
    exit_code, prefix = 4, "I/O error"


class DecodeError(CaptureError):
    exit_code, prefix = 5, "Data decode error"


class SnapshotError(CaptureError):
    exit_code, prefix = 5, "Snapshot error"


class ReplicationSlotError(CaptureError):
    exit_code, prefix = 6, "Replication slot error"


class StateError(CaptureError):
    exit_code, prefix = 7, "State store error"


class StateCorruption(StateError):
    prefix = "State store corruption"


class StateLocked(StateError):
    prefix = "State store in use"


class MigrationFailed(StateError):
    prefix = "Migration failed"


class TransformError(CaptureError):
    exit_code, prefix = 8, "Transform error"
