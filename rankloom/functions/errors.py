"""Whose fault a failed attempt was."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Wording that can only mean the local network went away.
TRANSPORT = (
    r"(?i)\b(ENOTFOUND|EAI_AGAIN|ECONNREFUSED|ECONNRESET|ENETDOWN|ENETUNREACH|EHOSTUNREACH"
    r"|UND_ERR_CONNECT_TIMEOUT|UND_ERR_SOCKET)\b|fetch failed|connection error|network is (down|unreachable)"
)
# Wording of an account that ran dry or was refused.
ACCOUNT = (
    r"(?i)\b(401|402|403)\b|insufficient credit|quota exceeded|payment required|out of credits|billing"
    r"|exceeds your (plan|usage)|plan limit|usage limit|credit limit"
)


def failed(error: Column) -> Column:
    """An empty message counts as no error, as a blank field does in the log."""
    return F.coalesce(error != "", F.lit(False))


def is_transport(error: Column) -> Column:
    return F.coalesce(error.rlike(TRANSPORT), F.lit(False))


def is_account(error: Column) -> Column:
    return F.coalesce(error.rlike(ACCOUNT), F.lit(False)) & ~is_transport(error)


def stage_of(stage: Column) -> Column:
    """An error nobody can place is 'unknown', never the provider's."""
    return F.coalesce(stage, F.lit("unknown"))


def is_provider_fault(error: Column, stage: Column) -> Column:
    """The recorded stage decides when present; without one the wording does."""
    return (
        failed(error)
        & F.coalesce((stage == "provider") | (stage == ""), F.lit(True))
        & ~is_transport(error)
        & ~is_account(error)
    )


def fault_class(error: Column, stage: Column) -> Column:
    return (
        F.when(~failed(error), "none")
        .when(is_transport(error), "transport")
        .when(is_account(error), "account")
        .when(is_provider_fault(error, stage), "provider")
        .otherwise("ours")
    )
