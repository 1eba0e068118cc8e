"""Column-expression builders (all JVM-side, codegen-friendly)."""
