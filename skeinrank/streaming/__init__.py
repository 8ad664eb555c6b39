"""No operator of this engine works on streams; the package keeps the place for them."""
