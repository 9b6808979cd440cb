"""The engine is batch only: recurring schedules have no event stream, so there is no streaming operator to offer."""
