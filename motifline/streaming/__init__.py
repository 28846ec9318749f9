"""Progress of running jobs. The engine has no streaming queries; a batch's progress can be polled."""
