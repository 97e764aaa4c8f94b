"""Retrying with growing delays."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Policy:
    retries: int = 5
    delay_s: float = 1.0
    factor: float = 3.0

    def next(self) -> Policy:
        return Policy(self.retries - 1, self.delay_s * self.factor, self.factor)


def on_failure_if(policy: Policy, wanted: Callable[[], bool], work: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T | None:
    """Runs work; after a failure again, if retries are left and wanted() holds.
    None if work failed and it wasn't wanted any more."""
    while True:
        try:
            return work()
        except Exception:
            if policy.retries <= 0:
                raise
            log.exception("failed, %s retries left", policy.retries)
            sleep(policy.delay_s)
            policy = policy.next()
            if not wanted():
                return None


def on_failure(policy: Policy, work: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T:
    return on_failure_if(policy, lambda: True, work, sleep)


def until(policy: Policy, condition: Callable[[T], bool], work: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T:
    """Runs work until its result fulfils condition; raises when retries run out."""
    while not condition(result := work()):
        if policy.retries <= 0:
            raise TimeoutError("the condition did not hold in time")
        sleep(policy.delay_s)
        policy = policy.next()
    return result
