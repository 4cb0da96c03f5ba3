"""A writer's session on a feed: acquire, stay the holder, lose, close."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from .. import model as M
from .feeds import ORDER, Feeds


@dataclass(frozen=True)
class LeasePolicy:
    """Seconds. A renewal and the slack must fit into a lease, and acquiring must outlast one."""

    ttl: float = 30.0
    renew: float = 10.0
    slack: float = 5.0
    acquire: float = 45.0

    def __post_init__(self) -> None:
        if not (0 < self.renew and 0 <= self.slack and self.renew + self.slack < self.ttl <= M.MAX_TTL_S and self.acquire >= self.ttl):
            raise M.InvalidRequest(f"lease policy {self}")


class Session:
    """M16. States: unacquired, active, lost, closed; a lost session never publishes again."""

    def __init__(self, feeds: Feeds, log: str, writer: str | None = None, policy: LeasePolicy = LeasePolicy()):
        self.feeds, self.log, self.policy = feeds, log, policy
        self.writer = writer or f"w-{uuid.uuid4().hex}"
        self.state, self.epoch, self.reason = "unacquired", 0, ""
        self._stop = threading.Event()

    def acquire(self, wait=None) -> int:
        """Claims the lease, waiting for another holder's to end for as long as the policy says."""
        if self.state in ("lost", "closed"):
            raise M.Rejected(f"session is {self.state}")
        end = self.feeds.clock() + self.policy.acquire
        pause = wait or self._stop.wait
        while True:
            try:
                self.epoch = self.feeds.claim(self.log, self.writer, self.policy.ttl)
                self.state = "active"
                return self.epoch
            except M.LeaseHeld:
                if self.feeds.clock() >= end:
                    raise
                pause(min(0.25, self.policy.renew))

    def active(self) -> int:
        """The epoch, if the lease outlasts the slack; else the session is lost."""
        if self.state != "active":
            raise M.Rejected(f"session is {self.state}")
        at = self.feeds.ref(self.log)
        if at.epoch != self.epoch or at.holder != self.writer:
            self.lose("fenced")
        elif at.until <= self.feeds.clock() + self.policy.slack:
            self.lose("expired")
        if self.state == "lost":
            raise M.LeaseExpired(f"{self.log}: {self.reason}")
        return self.epoch

    def renew(self) -> None:
        """One renewal; a fence or an ended lease loses the session, an unavailable store doesn't."""
        if self.state != "active":
            return
        try:
            self.feeds.renew_owned(self.log, self.writer, self.epoch, self.policy.ttl)
        except M.Unavailable:
            return
        except (M.Fenced, M.LeaseExpired, M.Rejected) as e:
            self.lose(e.code)

    def keep(self) -> threading.Thread:
        """Renews in the background until the session ends."""

        def run() -> None:
            while self.state == "active" and not self._stop.wait(self.policy.renew):
                self.renew()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def lose(self, reason: str) -> None:
        if self.state == "active":
            self.state, self.reason = "lost", reason
            self._stop.set()

    def append_stable(self, requests, identity: str):
        """M3: keys that are committed get their receipts without a lease; new ones need it."""
        fresh = requests.join(self.feeds.index(self.log), "key", "left_anti")
        if not fresh.isEmpty():
            if self.state == "unacquired":
                self.acquire()
            self.active()
        return self.feeds.append_stable(self.log, self.writer, requests.select("key", "payload", ORDER), identity, self.policy.ttl)

    def close(self) -> None:
        """Gives the lease back if it is still ours."""
        if self.state == "active":
            try:
                self.feeds.release(self.log, self.epoch, self.writer)
            except (M.Fenced, M.Rejected):
                pass
        self.state = "closed"
        self._stop.set()
