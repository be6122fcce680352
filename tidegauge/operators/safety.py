"""Rules of which processes may be ended. Nothing here sends a signal: the outcome is a plan table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.sources.tables import CRITICAL, IMPORTANT, PROTECTED, SYSTEM_USERS

# The texts of warnings.
PROTECTED_TEXT = "%s (PID %d) is a protected system process"
SYSTEM_TEXT = "%s (PID %d) is a system process (root-owned)"
SUDO_TEXT = "%s (PID %d) is owned by %s, may require elevated privileges"
IMPORTANT_TEXT = "WARNING: %s is an important system service. Killing it may cause unexpected behavior."
ROOT_TEXT = "CAUTION: This process is owned by root. Ensure you have a good reason to terminate it."
FOREIGN_TEXT = "CAUTION: This process is owned by %s. You may not have permission to kill it."
CRITICAL_TEXT = "CRITICAL: This is a core system process. Killing it may cause system instability or kernel panic."


def _text(template: str, *columns: str) -> Column:
    return F.format_string(template, *columns)


def listed_flags(df: DataFrame) -> DataFrame:
    """is_system and is_protected as the process list shows them: system users or low pids; protected names or pid 1."""
    return df.withColumns({"is_system": F.coalesce(F.col("user").isin(*SYSTEM_USERS), F.lit(False)) | (F.col("pid") < 100), "is_protected": F.coalesce(F.col("name").isin(*PROTECTED), F.lit(False)) | (F.col("pid") == 1)})


def flags_by_join(df: DataFrame, classes: DataFrame) -> DataFrame:
    """``listed_flags``' is_protected against a class table of fixed size, by a broadcast existence join."""
    named = classes.where("protected").select("name", F.lit(True).alias("__hit"))
    return df.join(F.broadcast(named), "name", "left").withColumn("is_protected", F.coalesce("__hit", F.lit(False)) | (F.col("pid") == 1)).drop("__hit")


def classified(df: DataFrame, me: str) -> DataFrame:
    """protected, system, sudo, label and warnings (ord, text) of each row, for the user ``me``.

    Protected (names, pid 1 and low pids) is looked at first; only what isn't protected can be system.
    """
    protected = F.coalesce(F.col("name").isin(*PROTECTED), F.lit(False)) | (F.col("pid") < 100)
    system = ~protected & F.coalesce(F.col("user").isin(*SYSTEM_USERS), F.lit(False))
    sudo = F.coalesce((F.col("user") != "") & (F.col("user") != me), F.lit(False)) & F.lit(me != "root")
    df = df.withColumns({"protected": protected, "system": system, "sudo": sudo})
    first = F.when(F.col("protected"), _text(PROTECTED_TEXT, "name", "pid")).when(F.col("system"), _text(SYSTEM_TEXT, "name", "pid"))
    second = F.when(F.col("sudo"), _text(SUDO_TEXT, "name", "pid", "user"))
    label = F.when(F.col("protected"), "CRITICAL").when(F.col("system"), "CAUTION").otherwise("OK")
    return df.withColumns({"label": label, "warnings": F.array_compact(F.array(first, second))})


def warnings(df: DataFrame, selected: DataFrame, me: str) -> DataFrame:
    """pid, ord (from 0), text: each warning about a selected process that exists, a row each, in no order."""
    hit = classified(df.join(selected.select("pid").distinct(), "pid"), me)
    return hit.select("pid", F.posexplode("warnings").alias("ord", "text"))


def _flags() -> list[Column]:
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return [F.count(F.lit(1)).alias("processes"), any_of("protected").alias("has_protected"), any_of("system").alias("has_system"), any_of("sudo").alias("requires_sudo"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("n_warnings")]


def confirmation_flags(df: DataFrame, selected: DataFrame, me: str) -> DataFrame:
    """One row about the selected processes that exist: how many, what they need, how many warnings. Two-phase, no lists."""
    return classified(df.join(selected.select("pid").distinct(), "pid"), me).agg(*_flags())


def confirmation(df: DataFrame, selected: DataFrame, me: str) -> DataFrame:
    """``confirmation_flags`` and the text of the dialog, all warnings in order of pid, by one aggregate.

    The text is one value, as long as the selection that a user has made; ``warnings`` has the same as rows.
    """
    hit = classified(df.join(selected.select("pid").distinct(), "pid"), me)
    told = F.array_sort(F.collect_list(F.when(F.size("warnings") > 0, F.struct("pid", "warnings"))))
    return hit.agg(*_flags(), F.array_join(F.flatten(F.transform(told, lambda t: t["warnings"])), " | ").alias("warnings"))


def kill_plan(df: DataFrame, selected: DataFrame, me: str, force: bool = False) -> DataFrame:
    """pid, action for each selected process that exists: SKIP_PROTECTED, else TERM (KILL if forced)."""
    hit = classified(df.join(selected.select("pid").distinct(), "pid"), me)
    return hit.select("pid", F.when(F.col("protected"), "SKIP_PROTECTED").otherwise("KILL" if force else "TERM").alias("action"))


def validated(df: DataFrame, me: str) -> DataFrame:
    """ok and warnings for ending one process: never a critical one; others with the warnings that apply."""
    critical = F.coalesce(F.col("name").isin(*CRITICAL), F.lit(False)) | (F.col("pid") == 1)
    important = F.when(F.col("name").isin(*IMPORTANT), _text(IMPORTANT_TEXT, "name"))
    root = F.when(F.col("user") == "root", F.lit(ROOT_TEXT))
    foreign = F.when((F.col("user") != "") & (F.col("user") != me) & F.lit(me != "root"), _text(FOREIGN_TEXT, "user"))
    stop = F.array(F.lit(CRITICAL_TEXT))
    return df.withColumns({"ok": ~critical, "warnings": F.when(critical, stop).otherwise(F.array_compact(F.array(important, root, foreign)))})
