"""Column expressions: text, money, dates and coercion. All stay inside the JVM."""
