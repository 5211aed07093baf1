"""Binary payloads."""
