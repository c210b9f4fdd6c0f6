"""Errors, each with the status code that a remote caller would see."""

from __future__ import annotations


class LogError(Exception):
    status = "Internal"


class InvalidArgument(LogError):
    status = "InvalidArgument"


class InvalidTopic(InvalidArgument):
    pass


class InvalidMessage(InvalidArgument):
    pass


class InvalidConsumer(InvalidArgument):
    pass


class NotFound(LogError):
    status = "NotFound"


class AlreadyExists(LogError):
    status = "AlreadyExists"


class OutOfRange(LogError):
    status = "OutOfRange"


class NotRunning(LogError):
    status = "Unavailable"


class Corrupt(LogError):
    status = "Internal"


#: Statuses by kind of failure, in the order in which they are matched; anything else is Internal.
STATUS_OF = {
    "cancelled": "Canceled",
    "deadline": "DeadlineExceeded",
    "invalid_name": "InvalidArgument",
    "reserved_name": "InvalidArgument",
    "invalid_config": "InvalidArgument",
    "invalid_partitions": "InvalidArgument",
    "invalid_message": "InvalidArgument",
    "invalid_consumer": "InvalidArgument",
    "topic_not_found": "NotFound",
    "partition_not_found": "NotFound",
    "already_exists": "AlreadyExists",
    "out_of_range": "OutOfRange",
    "invalid_offset": "OutOfRange",
    "not_running": "Unavailable",
}


def status_of(error: BaseException) -> tuple[str, str]:
    """Status and the text that may be shown; details of internal errors are hidden."""
    if isinstance(error, LogError) and error.status != "Internal":
        return error.status, str(error)
    if isinstance(error, TimeoutError):
        return "DeadlineExceeded", "request deadline exceeded"
    if isinstance(error, KeyboardInterrupt):
        return "Canceled", "request canceled"
    return "Internal", "internal error"
