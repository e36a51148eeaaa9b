"""Column expressions. All of them are built from native functions and stay in codegen."""
