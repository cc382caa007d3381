"""Delivery of rendered files to git remotes: prepare all, then push all, or put back what was pushed."""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
from datetime import datetime, timezone
from pathlib import Path

#: What a published folder says of its run.
MARK = "published.json"


class DeliveryError(RuntimeError):
    pass


def git(folder: Path, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True)
    if done.returncode:
        raise DeliveryError(f"git {args[0]}: {done.stderr.strip()[-300:]}")
    return done.stdout.strip()


def instant(text: str) -> datetime:
    """A point in time; without a zone it is UTC."""
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def guard(folder: Path, run_at: str) -> None:
    """Raise where the folder was published from a later run."""
    mark = folder / MARK
    if mark.exists() and instant((there := json.loads(mark.read_text()))["run_at"]) > instant(run_at):
        raise DeliveryError(f"{folder.name} holds the later run {there['run_id']} of {there['run_at']}")


def marked(folder: Path, run_id: str, run_at: str) -> None:
    (folder / MARK).write_text(json.dumps({"run_at": run_at, "run_id": run_id}, indent=1, sort_keys=True))


def deliver(files: Path, remotes: tuple[str, ...], branch: str, run_id: str, run_at: str) -> list[str]:
    """Commit the files on a branch of every remote; returns the commits. A remote that holds a later run refuses."""
    work = Path(tempfile.mkdtemp(prefix="delivery-"))
    ready, pushed = [], []
    try:
        for i, remote in enumerate(remotes):
            clone = work / str(i)
            subprocess.run(["git", "init", "-q", "-b", branch, str(clone)], check=True)
            git(clone, "remote", "add", "origin", remote)
            before = git(clone, "ls-remote", "origin", f"refs/heads/{branch}").split("\t")[0] or None
            if before:
                git(clone, "fetch", "-q", "--depth", "1", "origin", branch)
                git(clone, "reset", "-q", "--hard", "FETCH_HEAD")
                guard(clone, run_at)
            for path in clone.iterdir():
                if path.name != ".git":
                    shutil.rmtree(path) if path.is_dir() else path.unlink()
            shutil.copytree(files, clone, dirs_exist_ok=True)
            marked(clone, run_id, run_at)
            git(clone, "add", "-A")
            git(clone, "-c", "user.name=delivery", "-c", "user.email=delivery@localhost", "commit", "-q", "--allow-empty", "-m", f"Run {run_id}")
            ready.append((clone, before))
        for clone, before in ready:
            git(clone, "push", "-q", "origin", f"HEAD:refs/heads/{branch}")
            pushed.append((clone, before))
        return [git(clone, "rev-parse", "HEAD") for clone, _ in ready]
    except Exception:
        for clone, before in pushed:  # remotes must not differ
            git(clone, "push", "-q", "--force", "origin", f"{before}:refs/heads/{branch}" if before else f":refs/heads/{branch}")
        raise
    finally:
        shutil.rmtree(work, ignore_errors=True)
