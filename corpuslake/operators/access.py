"""Row-level visibility: who may see which rows, as Column predicates (ACL-*)."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles.
PUBLIC = "public"
SECURE_ROLES = ("sysadmin", "staff", "admin", "service")
WRITE_ROLES = ("sysadmin", "staff", "admin")
_PROJECT = "project:"


@dataclass(frozen=True)
class Access:
    """A caller: roles, and the projects that the caller is confined to (None: not confined)."""

    roles: tuple[str, ...] = (PUBLIC,)
    scope: tuple[str, ...] | None = None
    privileged: bool = False

    @property
    def tier(self) -> str:
        if self.scope is not None:
            return "scoped"
        return "privileged" if self.privileged else "role"


def roles_for(claims: list[str] | None) -> tuple[str, ...]:
    """public and the claimed roles, without those that name a project."""
    return tuple(dict.fromkeys([PUBLIC, *(r for r in claims or [] if r and not r.startswith(_PROJECT))]))


def scope_for(claims: list[str] | None, explicit: list[str] | None = None) -> tuple[str, ...] | None:
    """The explicit scope, an empty one included, else the projects named by roles, else no scope."""
    if explicit is not None:
        return tuple(dict.fromkeys(explicit))
    named = [r.removeprefix(_PROJECT) for r in claims or [] if r and r.startswith(_PROJECT)]
    return tuple(dict.fromkeys(named)) or None


def resolve_access(claims: list[str] | None, explicit: list[str] | None = None) -> Access:
    """Scope comes before privilege: a confined caller never sees everything."""
    scope, roles = scope_for(claims, explicit), roles_for(claims)
    return Access(roles, scope, scope is None and bool(set(roles) & set(SECURE_ROLES)))


def client_roles(claimed: list[str], allowed: list[str]) -> list[str]:
    """Privileged roles pass only from clients on the allow-list."""
    return [r for r in claimed if r not in SECURE_ROLES or r in allowed]


def can_write(roles: Column) -> Column:
    return F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, WRITE_ROLES))), F.lit(False))


def any_of(column: Column, values) -> Column:
    """IN with an empty list as false, never dropped."""
    values = list(values)
    return column.isin(values) if values else F.lit(False)


def all_of(*clauses: Column) -> Column:
    return reduce(operator.and_, clauses, F.lit(True))


@dataclass(frozen=True)
class Fragment:
    """A condition in SQL with its named parameters."""

    clause: str
    params: dict = field(default_factory=dict)


def joined(*fragments: Fragment | None) -> Fragment:
    """All conditions at once: true ones are left out, a false one decides. Two that name a parameter alike are an error, as one value would stand for both."""
    kept = [f for f in fragments if f is not None and f.clause and f.clause != "true"]
    if any(f.clause == "false" for f in kept):
        return Fragment("false")
    params: dict = {}
    for f in kept:
        if again := params.keys() & f.params.keys():
            raise ValueError(f"parameters of two conditions have one name: {', '.join(sorted(again))}")
        params |= f.params
    return Fragment(" AND ".join(f"({f.clause})" for f in kept) or "true", params)


def read_clause(access: Access, unset_is_public: bool = False, read: str = "read", published: str = "is_published") -> Column:
    if access.privileged:
        return F.lit(True)
    acl = F.col(read)
    overlap = F.coalesce(F.arrays_overlap(acl, F.array(*map(F.lit, access.roles))), F.lit(False))
    unset = acl.isNull() | (F.size(acl) == 0)
    return overlap | (unset if unset_is_public else unset & F.coalesce(F.col(published), F.lit(False)))


def scope_clause(access: Access, field: str | None) -> Column:
    if access.scope is None or field is None:
        return F.lit(True)
    return any_of(F.col(field), access.scope)


def visible(access: Access, field: str | None = "project_id", unset_is_public: bool = False) -> Column:
    """What list queries and single reads alike apply."""
    return all_of(read_clause(access, unset_is_public), scope_clause(access, field))


def search_visible(access: Access, field: str | None = "project_id") -> Column:
    """The search index knows the roles only: a row without roles is not found, published or not."""
    if access.privileged:
        return scope_clause(access, field)
    overlap = F.coalesce(F.arrays_overlap(F.col("read"), F.array(*map(F.lit, access.roles))), F.lit(False))
    return all_of(overlap, scope_clause(access, field))


def seed_acl(read: Column) -> Column:
    """Given roles that aren't blank; the secure roles where none were given at all."""
    secure = F.array(*map(F.lit, SECURE_ROLES))
    return F.when(read.isNull() | (F.size(read) == 0), secure).otherwise(F.filter(read, lambda r: F.trim(r) != ""))


def merge_acl(read: Column) -> Column:
    """Given roles, else public and the secure roles."""
    return F.when(F.size(read) > 0, read).otherwise(F.array(*map(F.lit, (PUBLIC, *SECURE_ROLES))))


def document_acl(wanted: Column, parent_public: Column) -> tuple[Column, Column]:
    """(is_published, read) of a new document: public only when asked for and the parent is public."""
    shown = F.coalesce(wanted, F.lit(False)) & F.coalesce(parent_public, F.lit(False))
    secure = list(map(F.lit, SECURE_ROLES))
    return shown, F.when(shown, F.array(F.lit(PUBLIC), *secure)).otherwise(F.array(*secure))


def key_valid(secret: Column, hash_: Column, revoked: Column, expires: Column, now: Column) -> Column:
    """Digest equal, not revoked, not expired; a junk date is not valid."""
    alive = expires.isNull() | F.coalesce(F.try_to_timestamp(expires) > now, F.lit(False))
    return F.coalesce((F.sha2(secret.cast("binary"), 256) == hash_) & revoked.isNull() & alive, F.lit(False))


def parse_key(key: Column) -> Column:
    """prefix_env_id_secret; the secret may hold underscores. Null where the form is another."""
    part = lambda i: F.regexp_extract(key, r"^([^_]+)_([^_]+)_([^_]+)_(.+)$", i)
    return F.when(part(4) != "", F.struct(part(1).alias("prefix"), part(2).alias("env"), part(3).alias("id"), part(4).alias("secret")))


def gate_by_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, access: Access, field: str = "project_id") -> DataFrame:
    """Rows whose parent is visible now; the rows' own roles are a snapshot."""
    return rows.join(parents.filter(visible(access, field)).select(F.col(parent_key).alias(key)), key, "left_semi")
