"""Column functions: text, dates, numbers, JSON and markup. All are JVM expressions."""
