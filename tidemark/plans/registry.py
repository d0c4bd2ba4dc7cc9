"""All registered queries of the transcript engine and their SQL."""

from tidemark.plans import analytics, copy, documents, edits, files, media, projects, scene_local, speakers, streams, styled, transcript

__all__ = ["ORACLE", "QUERIES", "analytics", "copy", "documents", "edits", "files", "media", "projects", "scene_local", "speakers", "streams", "styled"]
QUERIES: dict = transcript.QUERIES
ORACLE: dict = transcript.ORACLE
