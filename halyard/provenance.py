"""Where results come from: versions, code state, content hashes. Asking never fails."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@lru_cache(maxsize=1)
def code_state() -> dict:
    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if status is None else bool(status)}


def environment(spark: SparkSession | None = None) -> dict:
    out = {"python": platform.python_version(), "argv": sys.argv[1:], "code": code_state()}
    if spark is not None:
        out |= {"spark": spark.version, "application": spark.sparkContext.applicationId}
    return out


def launcher_manifests(paths: list[str], limit: int = 10 << 20) -> list[dict]:
    """Manifests of other programs as they are: objects of at most 10 MiB."""
    out = []
    for path in paths:
        p = Path(path)
        if p.stat().st_size > limit:
            raise ValueError(f"{path} is larger than {limit} bytes")
        body = json.loads(p.read_text(encoding="utf-8"))
        if not isinstance(body, dict):
            raise ValueError(f"{path} is no object")
        out.append({"path": str(p), "sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "content": body})
    return out
