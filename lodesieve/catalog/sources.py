"""Registered sources: id, display name and the reader that fits the storage format.

``lines`` is :func:`read_lines`, ``json`` :func:`explode_json_documents` (or its
salvaging form), ``rows`` :func:`table_to_records` on landed table rows,
``binary`` :func:`read_binary_as_text`, ``base64`` :func:`decode_base64_lines`,
and ``artifacts`` :func:`select_project_artifacts` in front of ``lines``.
"""

from __future__ import annotations

# Fixed values.
SOURCES: list[tuple[str, str, str]] = [
    ("claude-code", "Claude Code", "lines"),
    ("agent-configs", "Agent config files", "lines"),
    ("cursor", "Cursor", "rows"),
    ("codex-cli", "Codex CLI", "lines"),
    ("opencode", "OpenCode", "lines+rows"),
    ("aider", "Aider", "lines"),
    ("cline", "Cline", "lines"),
    ("roo-code", "Roo Code", "lines"),
    ("kilo-code", "Kilo Code", "lines+rows"),
    ("windsurf", "Windsurf", "binary"),
    ("pearai", "PearAI", "lines"),
    ("trae", "Trae", "rows"),
    ("void", "Void", "rows"),
    ("gemini-cli", "Gemini CLI", "lines"),
    ("qwen-code", "Qwen Code", "lines"),
    ("continue", "Continue", "json"),
    ("open-interpreter", "Open Interpreter", "lines"),
    ("goose", "Goose", "lines+rows"),
    ("copilot-chat", "GitHub Copilot Chat", "lines"),
    ("copilot-cli", "GitHub Copilot CLI", "lines"),
    ("llm", "LLM (Datasette)", "rows"),
    ("codebuff", "Codebuff", "json"),
    ("mentat", "Mentat", "lines"),
    ("hermes", "Hermes", "rows"),
    ("openclaw", "OpenClaw", "lines"),
    ("warp", "Warp", "rows"),
    ("crush", "Crush", "rows"),
    ("grok-cli", "Grok Build", "lines"),
    ("kiro-cli", "Kiro CLI", "lines+rows"),
    ("kiro-ide", "Kiro IDE", "lines"),
    ("zed", "Zed", "rows"),
    ("jetbrains-junie", "JetBrains Junie", "lines"),
    ("jetbrains-ai-assistant", "JetBrains AI Assistant", "lines+base64"),
    ("cody", "Sourcegraph Cody", "rows"),
    ("amazon-q", "Amazon Q Developer", "lines"),
    ("qodo-gen", "Qodo Gen", "lines"),
    ("openhands", "OpenHands", "lines"),
    ("factory-droid", "Factory Droid CLI", "lines"),
    ("devin-cli", "Devin CLI", "rows"),
    ("pi-agent", "Pi", "lines"),
    ("antigravity-cli", "Google Antigravity", "lines"),
    ("kimi-code", "Kimi Code", "lines"),
    ("fx", "fx", "lines"),
    ("atlassian-rovo-dev", "Atlassian Rovo Dev CLI", "json"),
    ("shell-history", "Shell & REPL history", "lines"),
    ("project-artifacts", "Project artifacts", "artifacts"),
]
