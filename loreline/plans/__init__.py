"""End-to-end jobs, input bindings and the registered queries."""
