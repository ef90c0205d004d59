"""The registry of algorithms (V9)."""

# Kind, id, name and length in bytes of each algorithm; null where the length varies.
ALGORITHMS = (
    ("mac", "h", "HMAC-SHA256", 32), ("mac", "s", "HMAC-SHA512", 64), ("mac", "p", "Poly1305", 16), ("mac", "b", "BLAKE3-keyed", 32), ("mac", "c", "CMAC-AES", 16),
    ("hash", "b", "BLAKE3", 32), ("hash", "s", "SHA-256", 32), ("hash", "t", "SHA-512", 64),
    ("signature", "e", "Ed25519", 64), ("signature", "p", "ECDSA-P256", 64), ("signature", "r", "RSA-2048", 256),
    ("key", "e", "Ed25519", 32), ("key", "x", "X25519", 32), ("key", "p", "ECDSA-P256", None), ("key", "r", "RSA-2048", None),
    ("key", "c", "ChaCha20-Poly1305", None), ("key", "a", "AES-256-GCM", None),
    ("wrap", "c", "ChaCha20-Poly1305", 32), ("wrap", "a", "AES-256-GCM", 32),
)
