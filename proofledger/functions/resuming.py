"""SHA-256 whose state can be handed on, so that one hash over many bytes needs no task that reads them all."""

from __future__ import annotations

import hashlib

#: About as many bytes of one sequential hash are read by one task.
PART_BYTES = 128 << 20


def resuming():
    """A function that makes a class like ``hashlib.sha256`` that starts from the ``state`` of another; AttributeError or OSError where
    Python's OpenSSL does not offer its functions. Self-contained, as Python workers need not have this package."""
    def make():
        import _hashlib
        import ctypes

        # The library that hashlib itself uses; a SHA256_CTX holds 112 bytes without pointers.
        library = ctypes.CDLL(_hashlib.__file__)
        start, add, end = library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
        add.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]

        class Digest:
            def __init__(self, data=b"", state=None):
                self.context = ctypes.create_string_buffer(state or bytes(112), 112)
                if state is None:
                    start(self.context)
                self.update(data)

            def update(self, data):
                add(self.context, data, len(data))

            def state(self):
                return self.context.raw

            def hexdigest(self):
                last, out = ctypes.create_string_buffer(self.context.raw, 112), ctypes.create_string_buffer(32)
                end(out, last)
                return out.raw.hex()

        return Digest

    return make


def can_resume() -> bool:
    """Whether hashes can be handed on here. Without it they stay in one task."""
    try:
        digest = resuming()()
    except (ImportError, OSError, AttributeError):
        return False
    text = bytes(range(100))
    return digest(text, digest(text).state()).hexdigest() == hashlib.sha256(text + text).hexdigest()
