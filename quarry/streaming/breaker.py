"""A breaker for loops of tool calls, and a ledger of fragile files: plain state machines.

Both take one record at a time and keep a bounded state, so one definition serves batches
(a fold per key) and streams (state per key).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

# Fixed values of the breaker: history, windows and thresholds of the patterns, levels, times in milliseconds.
HISTORY = 50
ERROR_WINDOW, SAME_ERRORS = 10, 3
FILE_WINDOW, SAME_FILE = 15, 5
CYCLES = 3
FILE_FAILURES = 3
LEVELS = 3
TTL_MS, INACTIVE_MS = 300_000, 60_000
SAVED_PER_TRIP = 10_000


@dataclass(frozen=True)
class Rules:
    """Which tools change files and which run tests, and the times that the breaker knows."""

    mutations: frozenset[str] = frozenset({"edit", "batch_edit", "undo"})
    tests: frozenset[str] = frozenset({"bash", "filter_output", "run_command"})
    ttl_ms: int = TTL_MS
    inactive_ms: int = INACTIVE_MS


@dataclass(frozen=True)
class Call:
    at: int  # milliseconds
    tool: str
    error: str | None = None  # fingerprint of the error, if the call failed
    file: str | None = None


@dataclass
class Breaker:
    """The state of one session.  ``history``: [time, tool, error, file] of the last calls."""

    history: list[list] = field(default_factory=list)
    tripped: str = ""
    tripped_file: str | None = None
    level: int = 0
    streak: int = 0
    failures: dict[str, int] = field(default_factory=dict)
    last_at: int = 0
    last_tool: str = ""
    calls: int = 0
    loops: int = 0
    redirects: int = 0
    redirects_worked: int = 0
    saved: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(state: str | None) -> Breaker:
        return Breaker(**json.loads(state)) if state else Breaker()

    def reset(self) -> None:
        """As new; only the statistics stay."""
        self.history, self.failures = [], {}
        self.tripped, self.tripped_file, self.level, self.streak = "", None, 0, 0

    def soft_reset(self) -> None:
        """No longer tripped, and without what is known of the file that tripped; the level stays."""
        self.tripped = ""
        if self.tripped_file is not None:
            self.history = [h for h in self.history if h[3] != self.tripped_file]
            self.failures.pop(self.tripped_file, None)
            self.streak = 0

    def call(self, c: Call, rules: Rules) -> tuple[str, int, bool]:
        """(reason, level, blocked) of a call; the reason is empty unless the breaker is tripped.

        Long inactivity resets a tripped breaker, another tool resets it softly.  A call
        to a breaker that is still tripped is blocked, not recorded; below the last level that resets it softly.
        """
        if self.tripped and c.at - self.last_at > rules.inactive_ms:
            self.reset()
        if self.tripped and self.last_tool and c.tool != self.last_tool:
            self.soft_reset()
        self.last_at, self.last_tool = c.at, c.tool
        if self.tripped:
            reason, level = self.tripped, self.level
            if level < LEVELS:
                self.soft_reset()
            return reason, level, True
        return (*self.record(c, rules), False)

    def record(self, c: Call, rules: Rules) -> tuple[str, int]:
        self.history = [*self.history, [c.at, c.tool, c.error, c.file]][-HISTORY:]
        self.calls += 1
        if c.error is None:
            self.streak = 0
            self.redirects_worked += self.level > 0
        else:
            self.streak += 1
        if c.file is not None:
            if c.error is None:
                self.failures.pop(c.file, None)
            else:
                self.failures[c.file] = self.failures.get(c.file, 0) + 1
        if not self.tripped:
            self._forget(c.at, rules)
            reason = self._pattern(rules)
            if reason:
                self._trip(reason)
        return self.tripped, self.level if self.tripped else 0

    def _forget(self, now: int, rules: Rules) -> None:
        self.history = [h for h in self.history if now - h[0] <= rules.ttl_ms]
        known = {h[3] for h in self.history}
        self.failures = {f: n for f, n in self.failures.items() if f in known}

    def _pattern(self, rules: Rules) -> str:
        """The first pattern that holds."""
        errors = Counter(h[2] for h in self.history[-ERROR_WINDOW:] if h[2] is not None)
        if errors and max(errors.values()) >= SAME_ERRORS:
            return "same error"
        files = Counter(h[3] for h in self.history[-FILE_WINDOW:] if h[3] is not None and h[1] in rules.mutations)
        if files and max(files.values()) >= SAME_FILE:
            return "same file"
        if self._cycles(rules) >= CYCLES:
            return "cycle"
        return "file failures" if self.failures and max(self.failures.values()) >= FILE_FAILURES else ""

    def _cycles(self, rules: Rules) -> int:
        """Change, test, failure in three calls in a row, counted without overlap."""
        n, i, h = 0, 0, self.history
        while i + 2 < len(h):
            changed = h[i][3] is not None and h[i][1] in rules.mutations
            tested = h[i + 1][1] in rules.tests or h[i + 1][2] is not None
            found = changed and tested and h[i + 2][2] is not None
            n, i = n + found, i + (3 if found else 1)
        return n

    def _trip(self, reason: str) -> None:
        self.level = min(self.level + 1, LEVELS)
        self.tripped, self.tripped_file = reason, self.history[-1][3]
        self.loops += 1
        self.redirects += self.level < LEVELS
        self.saved += SAVED_PER_TRIP


def trips(calls: Iterable[tuple[int, Call]], state: Breaker, rules: Rules) -> list[tuple[int, str, int, bool]]:
    """(id, reason, level, blocked) of the calls that meet or make a tripped breaker."""
    return [(k, *found) for k, c in calls if (found := state.call(c, rules))[0]]


# Fixed values of the ledger.
WEIGHTS = {"trip": 10.0, "error": 3.0, "heal": 1.0}
SUCCESS, SESSION_DECAY, FORGOTTEN = 0.5, 0.85, 1.0
REGRESSION, REGRESSION_POWER = 3.0, 1.2
ALERT = 15.0
MAX_DEBTS = 50


@dataclass
class Ledger:
    """One file: its score, when it was touched, and the symbols whose types were weakened."""

    score: float = 0.0
    session: int = 0
    trips: int = 0
    errors: int = 0
    heals: int = 0
    debts: dict[str, int] = field(default_factory=dict)  # symbol -> session

    def decay(self, session: int) -> None:
        """Sessions that passed wear the score off; below one it is forgotten, debts are not."""
        if session > self.session:
            self.score *= SESSION_DECAY ** (session - self.session)
            self.session = session
            if self.score < FORGOTTEN:
                if self.debts:
                    self.score = 0.0
                else:
                    self.score, self.trips, self.errors, self.heals = 0.0, 0, 0, 0

    def step(self, kind: str, session: int, symbols: list[str] | None = None) -> None:
        self.decay(session)
        if kind in WEIGHTS:
            self.score += WEIGHTS[kind]
            self.trips, self.errors, self.heals = self.trips + (kind == "trip"), self.errors + (kind == "error"), self.heals + (kind == "heal")
        elif kind == "success":
            self.score *= SUCCESS
            if self.score < FORGOTTEN:
                self.score, self.debts = 0.0, {}
        elif kind == "regressions" and symbols:
            self.score += REGRESSION * len(symbols) ** REGRESSION_POWER
            for s in symbols:
                self.debts.setdefault(s, session)
            self.debts = dict(sorted(self.debts.items(), key=lambda d: d[1])[-MAX_DEBTS:])
        elif kind == "restored":
            for s in symbols or []:
                self.debts.pop(s, None)

    @property
    def alert(self) -> bool:
        return self.score >= ALERT


def trend(before: int, after: int) -> str:
    """By the sign of the change of the number of errors."""
    return "improving" if after < before else "degrading" if after > before else "stable"
