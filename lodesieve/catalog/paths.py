"""Sensitive paths and suspicious commands."""

from __future__ import annotations

# What may stand on the two sides of a path in a command.
_LEFT = r"""(?:^|[\s'"`;|&(<>\\/])"""
_RIGHT = r"""(?:\z|[\s'"`;|&)<>])"""
_TEMPLATE_SUFFIX = "example|sample|template|dist|default|schema"

# Label and shape of each sensitive path; all ignore case, first one wins.
SENSITIVE_PATHS: tuple[tuple[str, str], ...] = (
    ("a .env file", _LEFT + rf"""\.env(?:\.(?!(?:{_TEMPLATE_SUFFIX})(?:\z|[\s'"`;|&)<>.]))[\w.-]+)?""" + _RIGHT),
    ("an SSH private key", _LEFT + "id_(?:rsa|dsa|ecdsa|ed25519)" + _RIGHT),
    ("the SSH directory", _LEFT + r"""\.ssh[\\/](?!(?:[\w.-]+\.pub|known_hosts(?:\.old)?)(?:\z|[\s'"`;|&)<>]))"""),
    ("a .pem key file", _LEFT + r"(?!public[-_.])[\w.-]+\.pem" + _RIGHT),
    ("a .key file", _LEFT + r"(?!public[-_.])[\w.-]+\.key" + _RIGHT),
    ("the AWS credentials file", _LEFT + r"\.aws[\\/](?:credentials|config)" + _RIGHT),
    ("the .netrc file", _LEFT + r"\.netrc" + _RIGHT),
    ("the .npmrc file (may hold a publish token)", _LEFT + r"\.npmrc" + _RIGHT),
    ("the git-credentials file", _LEFT + r"\.git-credentials" + _RIGHT),
    ("the Docker config (may hold registry auth)", _LEFT + r"\.docker[\\/]config\.json" + _RIGHT),
    ("the kubeconfig file", _LEFT + r"\.kube[\\/]config" + _RIGHT),
    ("gcloud application-default credentials", _LEFT + r"application_default_credentials\.json" + _RIGHT),
    ("a credentials.json file", _LEFT + r"credentials\.json" + _RIGHT),
    ("a GCP service-account key file", r"service[_-]?account[\w.-]*\.json" + _RIGHT),
    ("a secrets file", _LEFT + r"secrets?\.(?:json|ya?ml)" + _RIGHT),
)

# Signatures of hook commands, in order.
DROPPER_NAME = r"\bsetup\.mjs\b"
DOWNLOAD_TO_SHELL = r"\b(?:curl|wget)\b[^|;&\n]{0,200}\|\s*(?:ba|z|da|fi)?sh\b"
BASE64_DECODE = r"\bbase64\b\s+(?:-d|-D|--decode)\b"
SCRIPT_RUNNER = r"\b(?:node|bun|deno)\b"
DOT_DIR_SCRIPT = r"""(?:^|[\s"'/=])\.[A-Za-z0-9_][A-Za-z0-9_.-]*/[^\s"']*\.(?:mjs|cjs|js)\b"""
HOME_DOT_DIR_SCRIPT = r"""/\.[A-Za-z0-9_][A-Za-z0-9_.-]*/[^\s"']*\.(?:mjs|cjs|js)\b"""

# Server launch commands and pinned packages.
SERVER_DOWNLOAD_TO_SHELL = r"\b(?:curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh)\b"
NPM_PIN = r"\A(@[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+|[a-zA-Z0-9._-]+)@(\d[\w.-]*)\z"
PIP_PIN = r"\A([a-zA-Z0-9._-]+)==(\d[\w.-]*)\z"
LOOPBACK_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]")
