from gaugeworks.cli import main

raise SystemExit(main())
