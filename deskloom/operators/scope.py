"""Who may see what: a function from rows to visible rows. An empty scope sees nothing."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

BLIND = "UNICODE_CI_AI"  # the collation in which names are equal: neither case nor accents count


def real_group(grp: Column) -> Column:
    """Not a desk's own group, and not the group of all; neither case nor accents count."""
    return ~F.collate(grp, BLIND).startswith(F.lit("help")) & (F.collate(grp, BLIND) != "all")


def folded(names: tuple[str, ...]) -> list[str]:
    """Names as Python compares them: in lower case, without accents."""
    return ["".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c)) for x in names]


def among(c: Column, names: tuple[str, ...]) -> Column:
    """Whether a group's name is one of some; neither case nor accents count."""
    return F.collate(c, BLIND).isin(list(names)) if names else F.lit(False)


def account_among(c: Column, names: tuple[str, ...]) -> Column:
    """Whether an account is one of some. Ingest keeps accounts in lower case, so plain comparisons, which scans of messages can do fast, are enough."""
    return F.lower(c).isin([x.lower() for x in names])


def one_spelling(member: DataFrame) -> DataFrame:
    """Memberships with one spelling for group names that differ by case or accents alone, the least one, so that they group, join and sort as one name."""
    names = member.select("grp").distinct()
    least = names.groupBy(F.collate("grp", BLIND).alias("k")).agg(F.min("grp").alias("name"))
    same = names.join(least, F.collate("grp", BLIND) == F.col("k")).select("grp", "name")
    rest = [c for c in member.columns if c not in ("client", "grp")]
    named = member.join(same, "grp").withColumn("grp", F.col("name"))
    once = named.groupBy("client", "grp").agg(*(F.max(c).alias(c) for c in rest)) if rest else named.select("client", "grp").distinct()
    return once.select(member.columns)


@dataclass(frozen=True)
class Scope:
    """``everything``, or desks and groups; ``only_group`` narrows either to one group. Names are compared without case."""

    everything: bool = False
    accounts: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    only_group: str | None = None

    @classmethod
    def all(cls) -> Scope:
        return cls(everything=True)

    def _visible(self, rows: DataFrame, member: DataFrame, account: Column, real: bool) -> DataFrame:
        groups = member.where(real_group(F.col("grp")))
        if not self.everything:
            if not self.accounts and not self.groups:
                return rows.where(F.lit(False))
            mine = groups.where(among(F.col("grp"), self.groups)).select("client", F.lit(True).alias("__in")).distinct()
            rows = rows.join(mine, "client", "left").where(account | F.coalesce("__in", F.lit(False))).drop("__in")
        if real:
            rows = rows.join(groups.select("client").distinct(), "client", "left_semi")
        if self.only_group is not None:
            own = member.where(among(F.col("grp"), (self.only_group,)))
            rows = rows.join(own.select("client").distinct(), "client", "left_semi")
        return rows

    def messages(self, rows: DataFrame, member: DataFrame) -> DataFrame:
        """Messages of clients of real groups, each once, however many groups a client is in."""
        return self._visible(rows, member, account_among(F.col("author"), self.accounts) | account_among(F.col("recipient"), self.accounts), True)

    def tickets(self, rows: DataFrame, member: DataFrame) -> DataFrame:
        return self._visible(rows, member, account_among(F.col("account"), self.accounts), False)

    def group_rows(self, member: DataFrame) -> DataFrame:
        """Memberships in groups that may be listed."""
        if self.everything:
            return member
        return member.where(among(F.col("grp"), self.groups))

    def may_report(self, account: str) -> bool:
        """Whether a desk's own report may be seen: all of them, or those of desks granted."""
        return self.everything or folded((account,))[0] in folded(self.accounts)

    def narrowed(self, group: str) -> Scope:
        """One group of what is visible; asking for another is an error."""
        if not self.everything and folded((group,))[0] not in folded(self.groups):
            raise PermissionError(group)
        return replace(self, only_group=group)


# what the roles open; nothing else is open to anyone
ROLES = ("admin", "manager", "user")
OPEN_TO = {
    "admin": ("admin",), "metrics": ("admin", "manager"), "chat": ("admin", "manager"), "help": ("admin", "manager"),
    "companies": ROLES, "users": ROLES, "groups": ROLES,
}


def open_areas(accounts: DataFrame) -> DataFrame:
    """(user, area): what the role of each account (user, role, enabled) opens. Who isn't enabled, or has no known role, opens nothing."""
    opened = F.array_compact(F.array(*(F.when(F.col("role").isin(*roles), area) for area, roles in OPEN_TO.items())))
    return accounts.where("enabled").select("user", F.explode(opened).alias("area"))


def scope_in(accounts: DataFrame, grants: DataFrame, desk_groups: DataFrame, user: str, area: str) -> Scope:
    """The scope of a signed-in user in an area: all for an administrator, what is granted for others; an area that the role doesn't open is an error."""
    who = accounts.where((F.col("user") == user) & F.col("enabled")).first()
    if who is None or who.role not in OPEN_TO.get(area, ()):
        raise PermissionError(area)
    return Scope.all() if who.role == "admin" else scope_of(grants, desk_groups, user, "chats" if area == "chat" else "metrics")


def granted(grants: DataFrame, desk_groups: DataFrame, area: str = "metrics") -> DataFrame:
    """(user, account or null, grp) of the grants for an area: a desk grant also opens the groups that the desk serves."""
    own = grants.where(F.col(f"can_{area}"))
    desk = own.where("scope_type = 'help_account'").select("user", F.lower("scope_value").alias("account"))
    group = own.where("scope_type = 'group'").select("user", F.lit(None).cast("string").alias("account"), F.col("scope_value").alias("grp"))
    served = desk_groups.select(F.lower("account").alias("account"), "grp")
    return desk.join(served, "account", "left").select("user", "account", "grp").union(group).distinct()


def visible_groups(grants: DataFrame, desk_groups: DataFrame, area: str = "metrics") -> DataFrame:
    """(user, grp): the groups that a user may see listed, once whatever their case."""
    return granted(grants, desk_groups, area).where("grp IS NOT NULL").select("user", F.lower("grp").alias("grp")).distinct()


def scopes(grants: DataFrame, desk_groups: DataFrame, area: str = "metrics") -> DataFrame:
    """user, accounts, own_groups: the desks granted, and the groups granted as such, in order."""
    g = granted(grants, desk_groups, area)
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return g.groupBy("user").agg(
        names("account").alias("accounts"), names(F.when(F.col("account").isNull(), F.lower("grp"))).alias("own_groups")
    )


def scope_of(grants: DataFrame, desk_groups: DataFrame, user: str, area: str = "metrics") -> Scope:
    """The scope of one user; the driver holds one user's grants."""
    r = scopes(grants.where(F.col("user") == user), desk_groups, area).first()
    split = lambda x: tuple(x.split(",")) if x else ()
    return Scope() if r is None else Scope(accounts=split(r.accounts), groups=split(r.own_groups))
