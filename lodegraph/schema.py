"""Kinds, buckets and fixed orders of the artifact graph."""

from __future__ import annotations

GO_MODULE = "go_module"
GO_SYMBOL = "go_package_symbol"
IMAGE = "container_image"
BINARY = "cli_binary"
CRATE = "cargo_crate"
SERVICE = "service"
KINDS = (GO_MODULE, GO_SYMBOL, IMAGE, BINARY, CRATE, SERVICE)

#: Diagram order and headings of kinds; others follow under their own name.
KIND_ORDER = (GO_MODULE, IMAGE, BINARY, GO_SYMBOL)
KIND_LABELS = {GO_MODULE: "Go modules", IMAGE: "Container images", BINARY: "CLI binaries", GO_SYMBOL: "Go symbols"}

PRODUCER, CONSUMER = "producer", "consumer"
RESOLVED, EXTERNAL, DANGLING = "resolved", "external", "dangling"

FACTS = "role string, extractor string, root string, kind string, ref string, file string, line int"
ENTITIES = "ord long, name string, kind string, package string, file string, exported boolean, doc_comment string"
DOC_REFS = "ord long, text string, kind string, file string, line int"
