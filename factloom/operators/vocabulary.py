"""Selectors by name: categories of effects, and functions that check, compare, validate or normalise."""

from __future__ import annotations

from functools import reduce

from .selectors import Effect, Fn

#: What each named selector of effects selects.
EFFECTS = {
    "db.read": ("db_read",),
    "db.write": ("db_write",),
    "db.delete": ("db_delete",),
    "db.any": ("db_read", "db_write", "db_delete"),
    "data.read": ("db_read", "file_read", "cache_read"),
    "data.write": ("db_write", "file_write", "cache_write"),
    "data.any": ("db_read", "db_write", "db_delete", "file_read", "file_write", "cache_read", "cache_write"),
    "cache.read": ("cache_read",),
    "cache.write": ("cache_write",),
    "cache.any": ("cache_read", "cache_write"),
    "state.read": ("state_read",),
    "state.write": ("state_write",),
    "state.any": ("state_read", "state_write"),
    "config.write": ("config_write",),
    "response.write": ("response_write",),
    "outbound.request": ("outbound_request", "outbound_request_configured"),
    "outbound.controllable": ("outbound_request",),
    "mutation.write": ("db_write", "file_write", "cache_write", "state_write", "config_write", "response_write"),
    "mutation.delete": ("db_delete",),
    "mutation.persistent": ("db_write", "db_delete", "file_write", "cache_write", "state_write", "config_write"),
    "mutation.any": ("db_write", "db_delete", "file_write", "cache_write", "state_write", "config_write", "response_write"),
}

#: Qualified names, and a pattern of short ones where names vary by project.
FUNCTIONS = {
    "crypto.compare": (
        ("hmac.compare_digest", "werkzeug.security.check_password_hash", "bcrypt.checkpw", "passlib.hash.bcrypt.verify", "passlib.hash.argon2.verify", "argon2.verify_password", "argon2.PasswordHasher.verify", "passlib.context.CryptContext.verify"),
        r"^(check_password_hash|check_password|checkpw|verify_password|compare_digest)$",
    ),
    "crypto.hash": (("hashlib.sha256", "hashlib.sha512", "hashlib.sha384", "hashlib.sha3_256", "hashlib.pbkdf2_hmac", "hashlib.scrypt"), None),
    "token.verify": (("jwt.decode", "jose.jwt.decode", "authlib.jose.jwt.decode", "itsdangerous.URLSafeTimedSerializer.loads", "itsdangerous.URLSafeSerializer.loads", "itsdangerous.Signer.unsign"), None),
    "token.is_valid": ((), r"^(is_valid|is_active|verify|validate|check_token)$"),
    "schema.validate": (("pydantic.BaseModel.model_validate", "pydantic.BaseModel.model_validate_json", "marshmallow.Schema.load", "marshmallow.Schema.loads", "wtforms.Form.validate", "wtforms.Form.validate_on_submit", "cerberus.Validator.validate", "voluptuous.Schema.__call__"), None),
    "permission.check": ((), r"^(has_permission|check_permission|can_access|authorize|is_authorized)$"),
    "permission.require": ((), r"^(require_permission|require_role|require_admin|require_auth)$"),
    "str.case_fold": ((), r"^(lower|casefold)$"),
    "str.strip": ((), r"^(strip|lstrip|rstrip)$"),
    "str.unicode_normalize": (("unicodedata.normalize",), None),
}


def effect(name: str, key: str | None = None, scope: int | None = None) -> Effect:
    """The named selector of effects, with a key or scope bits if given."""
    return Effect(frozenset(EFFECTS[name]), None if key is None else frozenset((key,)), scope)


def function(name: str) -> Fn:
    """The named selector of functions: any of its qualified names, or its pattern."""
    fqns, pattern = FUNCTIONS[name]
    parts = [*(Fn(fqn=f) for f in fqns), *([Fn(pattern=pattern)] if pattern else [])]
    return reduce(Fn.__or__, parts)


def normalising() -> Fn:
    """All functions that change how a text compares."""
    return reduce(Fn.__or__, (function(n) for n in FUNCTIONS if n.startswith("str.")))
