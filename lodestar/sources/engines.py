"""What a run may plug in: language models, OCR engines and a page renderer.

All of them are small picklable objects. Nothing is called before it is asked
for, and what isn't installed or has no key says so through ``available``.
"""

from __future__ import annotations

import base64
import io
import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from lodestar.operators.ocr import api_text

#: Names that switch a backend off, and those of the local model server.
OFF = ("", "off", "false", "no", "disabled", "none")
LOCAL = ("ollama", "local")


class ServiceError(Exception):
    """A service can't be reached or replied with something unusable."""


def post_json(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    """The JSON reply to a JSON body. Whatever goes wrong on the way is a ServiceError that names the url."""
    body = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | headers, method="POST")
    try:
        with urllib.request.urlopen(body, timeout=timeout) as reply:
            return json.loads(reply.read().decode())
    except urllib.error.HTTPError as e:
        raise ServiceError(f"{url} replied {e.code}: {_said(e)}") from e
    except OSError as e:
        raise ServiceError(f"cannot reach {url}: {getattr(e, 'reason', e)}") from e
    except ValueError as e:
        raise ServiceError(f"malformed JSON from {url}: {e}") from e


def _said(reply: urllib.error.HTTPError) -> str:
    try:
        return reply.read().decode("utf-8", "ignore")[:300] or str(reply.reason)
    except (OSError, AttributeError):
        return str(reply.reason)


def reply_text(body) -> str:
    """The text of a model's reply: content or response, at the top or in a message, as a string or as parts; else ''."""
    if not isinstance(body, dict):
        return ""
    inner = body["message"] if isinstance(body.get("message"), dict) else {}
    for found in (inner.get("content"), body.get("content"), body.get("response")):
        if isinstance(found, list):
            found = "".join(p.get("text", "") for p in found if isinstance(p, dict))
        if isinstance(found, str):
            return found
    return ""


@dataclass
class ChatModel:
    """A local model server with a chat interface."""

    url: str = "http://localhost:11434"
    model: str = "llama3.2:3b"
    timeout: float = 120
    name: str = "ollama"

    def available(self) -> bool:
        return bool(self.url and self.model)

    def complete(self, system: str, prompt: str) -> str:
        said = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        return reply_text(post_json(f"{self.url.rstrip('/')}/api/chat", {"model": self.model, "stream": False, "messages": said}, {}, self.timeout))


@dataclass
class MessagesModel:
    """A hosted model with a messages interface. Its key comes from the environment and from nowhere else."""

    name: str
    url: str = ""
    model: str = ""
    key_variable: str = ""
    max_tokens: int = 1024
    timeout: float = 120
    headers: dict[str, str] = field(default_factory=dict)

    def _key(self) -> str:
        return os.environ.get(self.key_variable, "").strip() if self.key_variable else ""

    def available(self) -> bool:
        return bool(self.url and self.model and self._key())

    def complete(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": prompt}]}
        return reply_text(post_json(self.url, body, {"x-api-key": self._key()} | self.headers, self.timeout))


def select_model(settings: dict, asked: str | None = None) -> tuple[ChatModel | MessagesModel | None, str | None]:
    """The model of a backend and a warning. Settings are named llm_backend and llm_<backend>_<field>.

    A backend without settings of its own is taken for a misspelling: the local
    server is used, as another guess could send documents away.
    """
    backend = str(asked if asked is not None else settings.get("llm_backend", "none")).strip().lower()
    if backend in OFF:
        return None, None
    own = {k[len(backend) + 5 :]: v for k, v in settings.items() if k.startswith(f"llm_{backend}_")}
    if backend not in LOCAL and own:
        version = {k.removeprefix("header_").replace("_", "-"): str(v) for k, v in own.items() if k.startswith("header_")}
        return MessagesModel(backend, own.get("url", ""), own.get("model", ""), own.get("api_key_env", ""), int(own.get("max_tokens", 1024)), float(own.get("timeout", 120)), version), None
    near = {k.removeprefix("llm_ollama_"): v for k, v in settings.items() if k.startswith("llm_ollama_")}
    local = ChatModel(near.get("url", ChatModel.url), near.get("model", ChatModel.model), float(near.get("timeout", ChatModel.timeout)))
    return local, None if backend in LOCAL else f"unknown llm_backend '{backend}'; the local one is used"


@dataclass
class LocalOcr:
    """An OCR program on the machine; usable only if every language of the settings is installed."""

    languages: str = "eng"
    name: str = "tesseract"

    def available(self) -> bool:
        try:
            import pytesseract

            return set(self.languages.split("+")) <= set(pytesseract.get_languages())
        except Exception:  # absent library or program alike
            return False

    def ocr_image(self, image: bytes) -> str:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(image)), lang=self.languages)


@dataclass
class ApiOcr:
    """OCR by a hosted vision model: a PNG in a chat message."""

    url: str = ""
    model: str = ""
    key_variable: str = ""
    timeout: float = 60
    prompt: str = "Transcribe all text of this page."
    name: str = "api"

    def available(self) -> bool:
        return bool(self.url and self.model and os.environ.get(self.key_variable, "").strip())

    def ocr_image(self, image: bytes) -> str:
        picture = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}
        body = {"model": self.model, "messages": [{"role": "user", "content": [{"type": "text", "text": self.prompt}, picture]}]}
        return api_text(post_json(self.url, body, {"Authorization": f"Bearer {os.environ[self.key_variable].strip()}"}, self.timeout))


@dataclass
class PdfRenderer:
    """Pages of a PDF as PNG images. Opening fails where no library is installed."""

    dpi: int = 300

    def open(self, content: bytes):
        import pypdfium2

        return pypdfium2.PdfDocument(content)

    def render(self, opened, number: int) -> bytes | None:
        if not 1 <= number <= len(opened):
            return None
        out = io.BytesIO()
        opened[number - 1].render(scale=self.dpi / 72).to_pil().save(out, "PNG")
        return out.getvalue()
