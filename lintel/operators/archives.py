"""Members of archives: gates, and the memory budget, which is a fold over the members in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.config import Config
from lintel.functions import text
from lintel.operators.checks import as_messages, keyword_findings
from lintel.sources.archive_readers import Gate


def admitted_by_budget(members: DataFrame, key: str, order: str, size: str, budget: int, factor: Column | int = 1, passes: Column | None = None) -> DataFrame:
    """The members that an archive's budget admits: in order, one is read if `factor` times what was read before, and it, fit.

    What is read stays charged; a member that does not fit is left out, and later, smaller ones may
    fit again. A member that fails `passes` is neither read nor charged. factor is 1 for tar and 2
    for zip and 7z, whose members are charged twice.
    """
    ok = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
    f = F.lit(factor) if isinstance(factor, int) else factor
    # (used, admitted orders), folded over the sorted members of each archive; the members' other columns stay where they are.
    items = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(size).cast("bigint").alias("s"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("u"), F.array().cast("array<bigint>").alias("k"))
    folded = members.where(ok).withColumn("__f", f).groupBy(key).agg(items.alias("m"), F.max("__f").alias("f"))
    step = lambda a, x: F.when(F.col("f") * a.u + x.s <= budget, F.struct((a.u + x.s).alias("u"), F.concat(a.k, F.array(x.o)).alias("k"))).otherwise(a)
    kept = folded.select(F.col(key).alias("__key"), F.explode(F.aggregate("m", zero, step, lambda a: a.k)).alias("__ord"))
    return members.join(kept, (F.col(key) == F.col("__key")) & (F.col(order).cast("bigint") == F.col("__ord")), "left_semi")


def member_gate(config: Config, wl: tuple[str, ...] = (), bl: tuple[str, ...] = ()) -> Column:
    """No folder, not empty, not too large, wanted by its name, and text by sniffing."""
    limit = config.general.max_archive_file_size if config.general.max_archive_file_size > 0 else 10 << 20
    return ~F.col("is_dir") & (F.col("size") > 0) & (F.col("size") <= limit) & text.member_wanted(F.col("member"), wl, bl) & text.sniffed_text(F.col("content"))


def charge(name: Column) -> Column:
    return F.when(name.rlike(r"\.(zip|7z)$"), 2).otherwise(1)


def gate_of(config: Config, check: str = "IsArchiveFreeOfKeywords") -> Gate:
    """member_gate and the budget for the unpacking itself."""
    g, test = config.general, config.test(check)
    return Gate(g.max_archive_file_size if g.max_archive_file_size > 0 else 10 << 20, g.max_total_archive_memory if g.max_total_archive_memory > 0 else 100 << 20, tuple(test.whitelist), tuple(test.blacklist))


def member_messages(members: DataFrame, config: Config, check: str = "IsArchiveFreeOfKeywords", unpacked: bool = False) -> DataFrame:
    """Keyword findings in the members (see lintel.model.MEMBERS) that are read: for each member and set of keywords one.

    unpacked: the members come from read_members, which has let gates and budget decide already.
    """
    gate = gate_of(config, check)
    read = members.where("error is null")
    if unpacked:
        read = read.where("content is not null")
    else:
        read = admitted_by_budget(read, "archive_path", "ord", "size", gate.budget, charge(F.col("archive_name")), member_gate(config, gate.whitelist, gate.blacklist))
    found = keyword_findings(text.as_text(F.col("content")), F.lit(0), config, check)
    rows = read.select(F.col("archive_path").alias("path"), F.col("member").alias("name"), F.col("member").alias("display_name"), F.col("archive_label").alias("archive_name"), F.explode(found).alias("content"))
    return as_messages(rows.withColumn("test_name", F.lit(check)))


def listed_files(members: DataFrame) -> DataFrame:
    """The list of members as a files table, folders included."""
    from lintel.model import is_archive, suffix_of

    name = F.col("member")
    return members.where("error is null").select(
        F.col("archive_path").alias("path"), name.alias("name"), name.alias("display_name"), "size", suffix_of(name).alias("suffix"), is_archive(name).alias("is_archive"), F.col("archive_label").alias("archive_name")
    )
