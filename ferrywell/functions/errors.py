"""Likely cause and suggested fix for an error text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ErrorRule:
    cause: str
    fix: str
    any_of: tuple[tuple[str, ...], ...]  # one inner tuple must be contained completely


# The rules in the order they are tried; the first match wins.
ERROR_RULES = [
    ErrorRule(
        "The driver is not installed on the server", "Install the driver on the server",
        (("no module named",), ("cannot import name",)),
    ),
    ErrorRule(
        "Server unreachable", "Use a public endpoint and allow this network in the firewall",
        (("connection refused",), ("could not connect",), ("failed to connect",), ("cannot reach",)),
    ),
    ErrorRule(
        "Hostname cannot be resolved", "Check the server address",
        (("getaddrinfo",), ("no such host",), ("name or service not known",), ("nodename nor servname",)),
    ),
    ErrorRule(
        "Server did not respond", "Check that the server is up and not behind a firewall or VPN",
        (("timeout",), ("timed out",)),
    ),
    ErrorRule(
        "Username or password is incorrect", "Verify the credentials",
        (("authentication failed",), ("login failed",), ("password authentication",), ("incorrect password",)),
    ),
    ErrorRule(
        "User lacks permission on this database", "Grant connect, usage and select privileges",
        (("access denied",), ("permission denied",), ("insufficient privilege",)),
    ),
    ErrorRule(
        "SSL/TLS handshake failed", "Check the SSL setting and the server certificate",
        (("ssl",), ("certificate",), ("tls",)),
    ),
    ErrorRule(
        "Database or file not found", "Verify the name; it may be case-sensitive",
        (("database", "does not exist"), ("database", "not exist"), ("database", "unknown database"), ("no such file",)),
    ),
    ErrorRule(
        "Role/user does not exist on the server", "Create the user or check its spelling",
        (("role", "does not exist"),),
    ),
    ErrorRule(
        "ODBC driver missing on server", "Install the ODBC driver",
        (("odbc driver", "not found"),),
    ),
    ErrorRule(
        "Oracle service name not recognized", "Verify the service name on the listener",
        (("service_name",), ("tns",)),
    ),
    ErrorRule(
        "S3 bucket name is wrong or doesn't exist", "Check the exact bucket name",
        (("invalid bucket name",), ("nosuchbucket",)),
    ),
    ErrorRule(
        "AWS credentials are wrong", "Generate a new access key",
        (("signatureversion",), ("signature does not match",)),
    ),
]


def _matches(text: Column, rule: ErrorRule) -> Column:
    phrases = [reduce(Column.__and__, [text.contains(w) for w in words]) for words in rule.any_of]
    return reduce(Column.__or__, phrases)


def rule_number(message: Column) -> Column:
    """Number of the first rule that matches, from 1; null if none does."""
    low = F.lower(message)
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(ERROR_RULES, start=1))):
        out = F.when(_matches(low, rule), F.lit(number)).otherwise(out)
    return out


def cause_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(rule.cause) for rule in ERROR_RULES]), number - 1)


def fix_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(rule.fix) for rule in ERROR_RULES]), number - 1)
