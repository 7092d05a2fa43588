"""Reports over what ingest has stored: a desk pinned to one version, anew when another has been committed."""

from __future__ import annotations

from datetime import datetime, timedelta

from ..operators.scope import one_spelling
from ..plans.metrics import Period
from ..sources.adapter import Desk
from ..sources.store import Store
from . import ingest


def stored_desk(store: Store, state: dict | None = None, period: Period | None = None) -> Desk:
    """The tables of a version, the last one unless given. With a period only the months that it touches are read of the messages."""
    state = state or store.state()
    months = None if period is None else (f"{period.start:%Y-%m}", f"{period.end - timedelta(microseconds=1):%Y-%m}")
    newest = state.get("facts", {}).get("newest")
    horizon = datetime.fromisoformat(newest) + timedelta(seconds=1) if newest else None
    return Desk(ingest.messages(store, state, months).drop("dedup_hash"), ingest.tickets(store, state), one_spelling(store.table("client_group", state)), horizon)


class Served:
    """Desks over a store, held until a commit makes another version; who has one goes on with the version that it was made from."""

    def __init__(self, store: Store):
        self.store, self.version, self.desks = store, None, {}

    def desk(self, period: Period | None = None) -> Desk:
        state = self.store.state()
        if state["version"] != self.version:
            self.forget()
            self.version = state["version"]
        if period not in self.desks:
            made = stored_desk(self.store, state, period)
            made.ticket = made.ticket.persist()
            self.desks[period] = made
        return self.desks[period]

    def forget(self) -> None:
        for d in self.desks.values():
            d.ticket.unpersist()
        self.desks.clear()
