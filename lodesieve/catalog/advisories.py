"""Known-vulnerable versions of agent tool servers, from public advisories."""

from __future__ import annotations

# Id, ecosystem, package, severity, ranges (lowest, highest inclusive, highest exclusive), weakness.
ADVISORIES: list[tuple[str, str, str, str, list[tuple[str | None, str | None, str | None]], str]] = [
    ("CVE-2025-6514", "npm", "mcp-remote", "critical", [("0.0.5", None, "0.1.16")], "command injection"),
    ("CVE-2025-58444", "npm", "@modelcontextprotocol/inspector", "high", [(None, None, "0.16.6")], "cross-site scripting"),
    ("CVE-2025-49596", "npm", "@modelcontextprotocol/inspector", "critical", [(None, None, "0.14.1")], "missing authentication"),
    ("CVE-2026-23744", "npm", "@mcpjam/inspector", "critical", [(None, "1.4.2", None)], "remote code execution"),
    ("CVE-2025-65513", "npm", "mcp-fetch-server", "medium", [(None, "1.0.2", None)], "server-side request forgery"),
    ("CVE-2025-53372", "npm", "node-code-sandbox-mcp", "high", [(None, "1.2.0", None)], "sandbox escape"),
    ("CVE-2026-47250", "npm", "mcp-server-kubernetes", "medium", [(None, "3.6.2", None)], "flag injection"),
    ("CVE-2026-46519", "npm", "mcp-server-kubernetes", "high", [(None, None, "3.6.0")], "access control bypass"),
    ("CVE-2026-39884", "npm", "mcp-server-kubernetes", "high", [(None, "3.4.0", None)], "argument injection"),
    ("CVE-2025-66404", "npm", "mcp-server-kubernetes", "medium", [(None, "2.9.7", None)], "command injection"),
    ("CVE-2025-53355", "npm", "mcp-server-kubernetes", "high", [(None, None, "2.5.0")], "command injection"),
    ("CVE-2026-25536", "npm", "@modelcontextprotocol/sdk", "high", [("1.10.0", "1.25.3", None)], "cross-client data leak"),
    ("CVE-2026-0621", "npm", "@modelcontextprotocol/sdk", "high", [("1.3.0", None, "1.25.2")], "regex denial of service"),
    ("CVE-2025-66414", "npm", "@modelcontextprotocol/sdk", "high", [(None, None, "1.24.0")], "DNS rebinding"),
    ("CVE-2025-53110", "npm", "@modelcontextprotocol/server-filesystem", "high",
     [(None, "0.6.2", None), ("2025.1.14", None, "2025.7.1")], "path validation bypass"),
    ("CVE-2025-53109", "npm", "@modelcontextprotocol/server-filesystem", "high",
     [(None, "0.6.2", None), ("2025.1.14", None, "2025.7.1")], "path validation bypass"),
    ("CVE-2025-9611", "npm", "@playwright/mcp", "high", [(None, None, "0.0.40")], "DNS rebinding"),
    ("CVE-2026-59950", "pip", "mcp", "high", [(None, None, "1.28.1")], "missing origin validation"),
    ("CVE-2026-52869", "pip", "mcp", "high", [(None, "1.27.1", None)], "missing authorization"),
    ("CVE-2026-52870", "pip", "mcp", "high", [("1.23.0", "1.27.1", None)], "cross-client task access"),
    ("CVE-2025-66416", "pip", "mcp", "high", [(None, None, "1.23.0")], "DNS rebinding"),
    ("CVE-2025-53366", "pip", "mcp", "high", [(None, None, "1.9.4")], "denial of service"),
    ("CVE-2025-53365", "pip", "mcp", "high", [(None, None, "1.10.0")], "denial of service"),
    ("CVE-2026-27735", "pip", "mcp-server-git", "medium", [(None, None, "2026.1.14")], "path traversal"),
    ("CVE-2025-68145", "pip", "mcp-server-git", "medium", [(None, None, "2025.12.18")], "path validation bypass"),
    ("CVE-2025-68144", "pip", "mcp-server-git", "medium", [(None, None, "2025.12.18")], "argument injection"),
    ("CVE-2025-68143", "pip", "mcp-server-git", "medium", [(None, None, "2025.9.25")], "unrestricted repository creation"),
]

ADVISORY_SCHEMA = ("advisory_id string, ecosystem string, package string, severity string, "
                   "ranges array<struct<lowest:string,highest:string,below:string>>, weakness string")
