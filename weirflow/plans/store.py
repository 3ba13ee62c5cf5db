"""Content-addressed files, attempt logs and run manifests on a local or mounted folder.

Everything here is driver-side and small. Files appear whole, by rename; what is published
never changes. One advisory lock orders writers of a folder.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import datetime
from hashlib import sha256
from pathlib import Path

from weirflow.contracts import ContractError

CHUNK = 1 << 20
REMEMBERED = 64

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_DIGEST = re.compile(r"sha256:[0-9a-f]{64}")
_SECRET = re.compile(r"://[^/]+@|[?#].*(token|secret|password|credential)", re.IGNORECASE)


class RevisionConflict(ValueError):
    """Another writer published the manifest's next revision first."""


@dataclass(frozen=True)
class Artifact:
    object_id: str
    uri: str
    sha256: str
    media_type: str | None = None
    size_bytes: int | None = None

    def __post_init__(self):
        if not self.object_id:
            raise ContractError("object_id is required")
        if not _DIGEST.fullmatch(self.sha256):
            raise ContractError("sha256 must be sha256: and 64 hex digits")
        if _SECRET.search(self.uri):
            raise ContractError("a uri may not carry secrets")
        if self.size_bytes is not None and self.size_bytes < 0:
            raise ContractError("size_bytes must not be negative")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def digest_of(value) -> str:
    return sha256(canonical(value).encode()).hexdigest()


def input_digest(payload: bytes, static: tuple[Artifact, ...] = ()) -> str:
    """Of the payload alone, or bound to the static inputs that go with it."""
    own = sha256(payload).hexdigest()
    if not static:
        return own
    if len({a.object_id for a in static}) != len(static):
        raise ContractError("two static inputs share an object_id")
    named = [{"object_id": a.object_id, "sha256": a.sha256, "size_bytes": a.size_bytes, "media_type": a.media_type} for a in static]
    return digest_of({"client_input_digest": own, "static_input_refs": named})


def fingerprint(request_id: str, input_digest: str, pack: str, operation: str, params: Mapping, revision: str) -> str:
    return digest_of({"request_id": request_id, "input_digest": input_digest, "pack": pack, "operation": operation, "operation_params": params, "public_sha": revision})


def opaque(kind: str, text: str, size: int = 16) -> str:
    """A stable id that does not show what it was made from."""
    return f"{kind}-{sha256(text.encode()).hexdigest()[:size]}"


def component(name: str) -> str:
    """A name that is safe as one part of a path."""
    if not isinstance(name, str) or not _NAME.fullmatch(name) or name in (".", ".."):
        raise ContractError("a name must be letters, digits, dots, dashes and underscores")
    return name


def publish(path: Path, data: bytes) -> None:
    """Write a file so that it is seen whole or not at all, and survives a crash."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def hash_file(path: Path) -> tuple[str, int]:
    h, size = sha256(), 0
    with path.open("rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
            size += len(chunk)
    return f"sha256:{h.hexdigest()}", size


class Store:
    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()
        self.artifacts = self.root / "artifacts"
        self.runs = self.root / "runs"
        for folder in (self.artifacts, self.runs):
            folder.mkdir(parents=True, exist_ok=True)
        self._checked: OrderedDict[tuple, bool] = OrderedDict()

    @contextmanager
    def lock(self) -> Iterator[None]:
        with (self.root / ".lock").open("a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def path(self, artifact: Artifact) -> Path:
        return self.artifacts / artifact.sha256.removeprefix("sha256:")

    def write(self, data: bytes, media_type: str | None = None) -> Artifact:
        name = sha256(data).hexdigest()
        target = self.artifacts / name
        with self.lock():
            if not target.exists():
                publish(target, data)
        return Artifact(name, target.as_uri(), f"sha256:{name}", media_type, len(data))

    def read(self, artifact: Artifact) -> bytes:
        data = self.path(artifact).read_bytes()
        if f"sha256:{sha256(data).hexdigest()}" != artifact.sha256 or artifact.size_bytes not in (None, len(data)):
            raise ContractError("artifact does not match its digest")
        return data

    def exists(self, artifact: Artifact) -> bool:
        return self.path(artifact).is_file()

    def _version(self, artifact: Artifact) -> tuple | None:
        """What tells versions of a file apart without reading it; none if there is no such file."""
        try:
            s = self.path(artifact).stat()
        except OSError:
            return None
        return artifact.sha256, s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns

    def verify(self, artifact: Artifact) -> bool:
        """Whether the file is there and right. A version of it is hashed once while it is
        among those used last; a file that changes while it is read is not right."""
        version = self._version(artifact)
        if version is None or artifact.size_bytes not in (None, version[3]):
            return False
        right = self._checked.pop(version, False)
        if not right:
            try:
                right = hash_file(self.path(artifact))[0] == artifact.sha256 and self._version(artifact) == version
            except OSError:
                right = False
        if right:
            self._checked[version] = True  # at the end, as the one used last
            while len(self._checked) > REMEMBERED:
                self._checked.popitem(last=False)
        return right

    def _need(self, refs: Iterable[Mapping]) -> None:
        """Every named output must be in this store, as its reference says."""
        fields = Artifact.__dataclass_fields__
        missing = [r["sha256"] for r in refs if not self.verify(Artifact(**{k: v for k, v in r.items() if k in fields}))]
        if missing:
            raise ContractError(f"outputs must exist: {', '.join(missing)}")

    @contextmanager
    def verified_copy(self, artifact: Artifact) -> Iterator[Path]:
        """A temporary copy whose digest and size were checked while it was made."""
        with tempfile.NamedTemporaryFile(dir=self.root, suffix=".tmp") as out, self.path(artifact).open("rb") as f:
            h, size = sha256(), 0
            while chunk := f.read(CHUNK):
                h.update(chunk)
                size += len(chunk)
                out.write(chunk)
            out.flush()
            if f"sha256:{h.hexdigest()}" != artifact.sha256 or artifact.size_bytes not in (None, size):
                raise ContractError("artifact does not match its digest")
            yield Path(out.name)

    # attempts: one immutable file each

    def append_attempt(self, run_id: str, attempt: Mapping) -> None:
        check_attempt(attempt)
        self._need(attempt.get("output_refs") or ())
        path = self.runs / component(run_id) / "attempts" / f"{component(attempt['attempt_id'])}.json"
        data = (canonical(dict(attempt)) + "\n").encode()
        with self.lock():
            if path.exists():
                if path.read_bytes() != data:
                    raise ContractError("attempt_id belongs to another record")
                return
            publish(path, data)

    def attempts(self, run_id: str) -> list[dict]:
        folder = self.runs / component(run_id) / "attempts"
        found = [json.loads(p.read_text()) for p in folder.glob("*.json")] if folder.is_dir() else []
        return sorted(found, key=lambda a: (a["finished_at"], a["started_at"], a["attempt_id"]))

    # manifests: every revision stays, the next one must follow the last

    def manifest(self, run_id: str) -> dict | None:
        path = self.runs / component(run_id) / "latest.json"
        return json.loads(path.read_text()) if path.exists() else None

    def write_manifest(self, run_id: str, manifest: Mapping, expected_revision: int) -> dict:
        """Publish the revision after the expected one; only one of several writers can."""
        revision, folder = expected_revision + 1, self.runs / component(run_id)
        if manifest.get("revision") != revision:
            raise ContractError("the next revision must be one higher")
        data = (canonical(dict(manifest)) + "\n").encode()
        kept = folder / "manifests" / f"{revision:020d}.json"
        with self.lock():
            found = (self.manifest(run_id) or {"revision": -1})["revision"]
            if found != expected_revision or kept.exists():
                raise RevisionConflict(f"expected revision {expected_revision}, found {found}")
            self._need(manifest.get("final_output_refs") or ())
            for path in (kept, folder / "latest.json"):
                publish(path, data)
        return dict(manifest)


def check_attempt(a: Mapping) -> None:
    if a.get("status") not in ("succeeded", "failed", "cancelled"):
        raise ContractError("status must be succeeded, failed or cancelled")
    if datetime.fromisoformat(a["finished_at"]) < datetime.fromisoformat(a["started_at"]):
        raise ContractError("an attempt cannot end before it starts")
    if bool(a.get("failure")) != (a["status"] == "failed") and a["status"] != "cancelled":
        raise ContractError("failed attempts, and only they, name a failure")
    if a["status"] != "succeeded" and (a.get("output_refs") or a.get("output_digest")):
        raise ContractError("only a success publishes output")
    if any(v < 0 for v in (a.get("counts") or {}).values()):
        raise ContractError("counts must not be negative")


class Controller:
    """The only writer of manifests: judges attempts, then finalizes a complete run."""

    def __init__(self, spark, store: Store):
        self.spark, self.store = spark, store

    def refresh(self, run_id: str, shards, expected_revision: int) -> dict:
        from weirflow.plans import planning

        before = self.store.manifest(run_id) or {"run_id": run_id, "status": "planned"}
        schema = "shard_id string, attempt_id string, status string, input_digest string, fingerprint string, started_at string, finished_at string"
        names = [c.split()[0] for c in schema.split(", ")]
        tried = self.spark.createDataFrame([tuple(a.get(n) for n in names) for a in self.store.attempts(run_id)], schema)
        states: dict[str, list] = {"canonical": [], "missing": [], "duplicate": []}
        # the manifest lists its shards, so it is this large anyway
        for r in planning.completeness(shards, tried).orderBy("shard_id").collect():
            states[r["state"]].append(r["shard_id"] if r["state"] != "canonical" else (r["shard_id"], r["canonical_attempt"]))
        ready = not states["missing"] and not states["duplicate"]
        after = before | {
            "revision": expected_revision + 1, "status": "running", "finalization_status": "ready" if ready else "not_started",
            "completed_shard_ids": [s for s, _ in states["canonical"]], "canonical_attempts": [a for _, a in states["canonical"]],
            "missing_shard_ids": states["missing"], "duplicate_shard_ids": states["duplicate"],
        }
        return self.store.write_manifest(run_id, after, expected_revision)

    def finalize(self, run_id: str, expected_revision: int, outputs: tuple[Artifact, ...]) -> dict:
        before = self.store.manifest(run_id)
        if not before or before["revision"] != expected_revision or before["finalization_status"] != "ready":
            raise ContractError("the run is not ready to be finalized")
        if not outputs or not all(self.store.verify(a) for a in outputs):
            raise ContractError("final outputs must exist")
        after = before | {"revision": expected_revision + 1, "status": "succeeded", "finalization_status": "finalized", "final_output_refs": [asdict(a) for a in outputs]}
        return self.store.write_manifest(run_id, after, expected_revision)
